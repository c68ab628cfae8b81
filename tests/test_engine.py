"""Known answers on one small trading day, over dated Parquet files."""

import pytest
from pyspark.sql import Row

from quantloom import (
    Aggregate, Col, Engine, FactorRecipe, FillNull, Flag, Grid, Join, Model, Node, Op, ParquetCatalog, Project, Side, Source,
    Threshold, TopQuantile, TradingCalendar, Where, last, metric, register_operator, transform,
)
from quantloom.plans.frame import Frame
from quantloom.sources.contracts import COLUMNS

DATE = "20170103"
BARS = [
    (925, 9.85, 0, 10.0, True, True, 1), (930, 10.1, 0, 10.0, True, False, 99), (930, 10.2, 0, 5.0, False, True, 1), (931, None, None, None, None, None, None),
    (932, 10.5, 0, 30.0, True, True, 4), (933, 10.3, 0, 20.0, True, True, 5), (935, None, None, None, None, None, None), (1500, 10.85, 0, 10.0, True, True, 7),
]
VENDOR = "SecuCode long, MinBar long, Price double, Side long, Volume double, vw_wait_time double, isfirst boolean, islast boolean, No long"


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(path))


def bars(spark, root, date, rows, source="trades_tbar"):
    write(spark, [(1, m, p, s, v, 0.0, f, la, n) for m, p, s, v, f, la, n in rows], VENDOR, root / "data" / source / f"{date}.parquet")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("market")
    write(spark, [("2017-01-03",), ("20170104",)], "date string", root / "external" / "trading_days.parquet")
    for d in (DATE, "20170104"):
        write(spark, [(1,), (2,), (2,)], "secu_code long", root / "data" / "universe" / "ex2kamt" / f"{d}.parquet")
        numbers = [c for c in COLUMNS["daily_k"] if c not in ("sec_code", "date", "secu_code", "preclose", "isSuspend", "isST", "list_date")]
        schema = "sec_code string, trading_day string, preclose double, isSuspend boolean, isST boolean, list_date string, " + ", ".join(f"{c} double" for c in numbers)
        write(spark, [(f"00000{k}.SZ", f"{d[:4]}-{d[4:6]}-{d[6:]}", p, False, False, "x", *([1.0] * len(numbers))) for k, p in ((1, 9.5), (2, 20.0))], schema, root / "data" / "daily_k" / f"{d}.parquet")
    bars(spark, root, DATE, BARS)
    bars(spark, root, "20170104", [(930, 11.0, 1, 4.0, True, True, 1), (931, 12.0, 0, 6.0, True, True, 2)])
    bars(spark, root, DATE, [(930, 10.0, 0, 7.0, True, True, 1)], "quotes_tbar")
    return root


@pytest.fixture(scope="module")
def engine(spark, root):
    return Engine(ParquetCatalog(spark, str(root / "data")))


SRC = Source("trades_tbar")


def frame(engine, node, dates=(DATE,), universe="ex2kamt"):
    return engine.frame(Model("m", universe, {"value": node}), node, list(dates))


def at(engine, node, value=None, dates=(DATE,)):
    made = frame(engine, node, dates)
    value = value or made.value()
    keys = [k for k in made.keys if k not in ("date", "secu_code")]
    return {tuple(r[k] for k in keys) if len(keys) != 1 else r[keys[0]]: r[value] for r in made.df.where("secu_code = 1").collect()}


def test_metrics(engine):
    assert at(engine, metric("amount")(SRC))[930] == pytest.approx(152)
    assert at(engine, metric("volume")(SRC))[931] is None
    assert at(engine, metric("open")(SRC))[930] == 10.1 and at(engine, metric("close")(SRC))[930] == 10.2
    assert at(engine, metric("high")(SRC))[930] == 10.2 and at(engine, metric("low")(SRC))[930] == 10.1 and at(engine, metric("no")(SRC))[930] == 100
    assert at(engine, metric("vwap")(SRC))[930] == pytest.approx(152 / 15)


def test_vwap_by_components_and_by_field(engine):
    vwap = metric("vwap")(SRC)
    assert at(engine, Aggregate("5m", "sum", apply_to="components")(vwap), "vwap")[930] == pytest.approx(673 / 65)
    assert at(engine, Aggregate("5m", "mean")(vwap))[930] == pytest.approx((152 / 15 + 10.5 + 10.3) / 3)


def test_auctions(engine):
    volume = lambda f, a, agg="sum": at(engine, Aggregate(f, agg, value_col="volume", auction=a)(SRC))
    one, five = volume("1m", "merge"), volume("5m", "merge")
    assert (one[930], one[1456]) == (25, 10) and (five[930], five[1455]) == (75, 10) and 925 not in one
    assert set(volume("1m", "drop")) == {930, 931, 932, 933, 935}
    daily = lambda a: at(engine, Aggregate("1d", "mean", auction=a)(metric("volume")(SRC)))[()]
    assert daily("keep") == pytest.approx(85 / 5) and daily("drop") == pytest.approx(65 / 3) and daily("merge") == pytest.approx(72.5 / 4)
    ends = lambda agg: at(engine, Aggregate("15m", agg, value_col="price", alias="p", auction="merge")(SRC))
    assert ends("first")[930] == 9.85 and ends("last")[1445] == 10.85


def test_collect(engine):
    model = Model("close_last", "ex2kamt", {"value": Aggregate("1d", "last")(metric("close")(SRC))})
    assert engine.collect(model, [DATE], ordered=True).collect() == [
        Row(date=DATE, secu_code=1, factor_name="close_last", value=10.85), Row(date=DATE, secu_code=2, factor_name="close_last", value=None)
    ]
    two = Model("m", "ex2kamt", {"amount": Aggregate("1d", "sum")(metric("amount")(SRC)), "close": model.output["value"]})
    rows = {(r.date, r.secu_code, r.factor_name): r.value for r in engine.collect(two, ["2017-01-03", "20170104"]).collect()}
    assert len(rows) == 8 and rows[DATE, 1, "m__amount"] == pytest.approx(880.0) and rows["20170104", 1, "m__close"] == 12.0
    many = engine.collect_many([model, two], [DATE, "20170104"])
    apart = engine.collect(model, [DATE, "20170104"]).union(engine.collect(two, [DATE, "20170104"]))
    assert sorted(many.collect(), key=str) == sorted(apart.collect(), key=str)
    engine.release()


def test_collect_refuses(engine):
    volume = metric("volume")(SRC)
    with pytest.raises(ValueError, match="daily"):
        engine.collect(Model("m", "ex2kamt", {"value": volume}), [DATE])
    with pytest.raises(ValueError, match="universe"):
        engine.collect(Model("m", None, {"value": volume}), [DATE])
    with pytest.raises(ValueError, match="date"):
        engine.collect(Model("m", "ex2kamt", {"value": volume}), [])
    with pytest.raises(ValueError, match="session"):
        engine.collect(Model("m", "ex2kamt", {"value": Aggregate("1d", "sum")(volume)}), ["20170105"])
    with pytest.raises(ValueError, match="differ"):
        engine.collect_many([Model("m", "ex2kamt", {"value": volume})] * 2, [DATE])
    with pytest.raises(ValueError):
        engine.collect_many([], [DATE])


def test_filters(engine):
    assert set(at(engine, Aggregate("1m", "sum", value_col="no")(last(932)(SRC)))) == {932, 933, 935, 1500}
    assert len(frame(engine, Where(Side("buy"))(SRC)).df.collect()) == 6 and frame(engine, Where(Side("sell"))(SRC)).df.count() == 0
    assert frame(engine, Where(Flag("is_last"))(SRC)).df.count() == 5
    top = frame(engine, Where(TopQuantile("volume", q=0.5, over=["date", "secu_code"]))(SRC)).df.collect()
    assert sorted(r.volume for r in top) == [10.0, 10.0, 10.0, 20.0, 30.0]
    assert frame(engine, Where(Threshold("volume", op="!=", value=10))(SRC)).df.count() == 3
    for bad in (lambda: Side("x"), lambda: Threshold("a", op="~"), lambda: TopQuantile("a", q=2), lambda: last("1"), lambda: Where("x")):
        with pytest.raises((ValueError, TypeError)):
            bad()


def test_arithmetic(engine):
    volume, amount = metric("volume")(SRC), metric("amount")(SRC)
    assert at(engine, Project()((1 / (volume - 15)).alias("z")))[930] is None
    assert at(engine, Project()((2 * volume + 1).alias("z")))[932] == 61
    assert at(engine, Project()((amount / volume - 10).alias("z")))[932] == pytest.approx(0.5)
    row = ((Col("price") - 10) / (Col("volume") - 10)).alias("z")(SRC)
    assert frame(engine, row).df.where("minute = 925").first().z is None
    assert "z" in frame(engine, row).columns and frame(engine, row).fields["z"].operator == "div"
    for bad in (lambda: Op("pow", volume, 1), lambda: Op("add", volume, Col("x")), lambda: Op("add", volume, "x"), lambda: volume.alias("minute"), lambda: Col("a").alias("__b")):
        with pytest.raises((ValueError, TypeError)):
            bad()
    with pytest.raises(ValueError, match="identity keys"):
        frame(engine, volume + Aggregate("1d", "sum")(volume))
    with pytest.raises(ValueError, match="exactly one"):
        frame(engine, SRC + 1)


def test_fused_operands_need_one_exchange(engine):
    vwap = metric("vwap")(SRC)
    plan = frame(engine, vwap).df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    span = frame(engine, metric("high")(SRC) - metric("low")(SRC))
    assert "Join" not in span.df._jdf.queryExecution().executedPlan().toString() and at(engine, Project()(metric("high")(SRC) - metric("low")(SRC)))[930] == pytest.approx(0.1)
    apart = frame(engine, metric("buyamount")(SRC) / metric("amount")(SRC)).df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in apart


def test_grid(engine):
    grid = frame(engine, Grid()(metric("volume")(SRC)))
    assert grid.df.count() == 2 * 239 and grid.keys == ("date", "secu_code", "minute")
    assert frame(engine, Grid()(Aggregate("5m", "sum", value_col="volume", auction="drop")(SRC))).df.count() == 2 * 48
    assert frame(engine, Grid("5m", auction="keep")(SRC)).df.count() == 2 * 50 + 1
    raw = frame(engine, Grid()(SRC))
    assert raw.df.count() == 2 * 239 + 1
    daily = frame(engine, Grid("1m")(Aggregate("1d", "sum", value_col="volume")(SRC)))
    assert daily.df.where("secu_code = 1 and volume = 85").count() == 239
    with pytest.raises(ValueError, match="universe"):
        frame(engine, Grid()(SRC), universe=None)
    with pytest.raises(ValueError, match="frequency"):
        frame(engine, Grid()(Join()({"a": metric("volume")(SRC), "b": Aggregate("5m", "sum")(metric("volume")(SRC))})))


def test_fill(engine):
    grid = Grid()(metric("close")(SRC))
    assert at(engine, FillNull("ffill")(grid))[931] == 10.2 and at(engine, FillNull(0)(grid))[931] == 0
    vwap = FillNull("state")(metric("vwap")(SRC))
    assert at(engine, vwap)[935] == 10.3
    before = at(engine, FillNull("state")(metric("preclose")(SRC)))
    assert before[930] == 9.85 and before[925] == 9.5 and set(before) == {925, 930, 932, 933, 1500}
    whole = {(r.secu_code, r.minute): r.close for r in frame(engine, FillNull("state")(grid)).df.collect()}
    assert whole[2, 930] == 20.0 and whole[1, 1000] == 10.3
    with pytest.raises(ValueError):
        FillNull("bfill")
    with pytest.raises(ValueError, match="minute"):
        frame(engine, FillNull("state")(Aggregate("1d", "sum")(metric("volume")(SRC))))
    with pytest.raises(ValueError, match="preclose"):
        frame(engine, metric("preclose")(SRC))
    with pytest.raises(ValueError, match="components"):
        frame(engine, Aggregate("5m", "sum", apply_to="components")(FillNull(0)(metric("vwap")(SRC))))
    with pytest.raises(ValueError, match="single source"):
        frame(engine, FillNull("state")(metric("volume")(SRC) / metric("volume")(Source("quotes_tbar"))))


def test_joins(engine):
    trades, quotes = metric("volume")(SRC), metric("volume")(Source("quotes_tbar"))
    made = {r.minute: (r.t, r.q) for r in frame(engine, Join()({"t": trades, "q": quotes})).df.collect()}
    assert made[930] == (15, 7) and made[932] == (30, None)
    assert frame(engine, Join(how="left")({"q": quotes, "t": trades})).df.count() == 1
    assert frame(engine, Join(how="left", on=("date", "secu_code"))({"t": trades, "d": Aggregate("1d", "sum")(trades)})).values == ("t", "d")
    both = frame(engine, Join()({"a": Join()({"t": trades, "q": quotes}), "v": trades}))
    assert both.values == ("a__t", "a__q", "v")
    vwaps = Join()({"w": metric("vwap")(SRC)})
    assert at(engine, Aggregate("5m", "sum", apply_to="components")(vwaps), "w")[930] == pytest.approx(673 / 65)
    for how, on, inputs in (("full", None, {"t": trades, "d": Aggregate("1d", "sum")(trades)}), ("left", ("date",), {"t": trades, "q": quotes}), ("left", ("price",), {"t": trades, "s": SRC})):
        with pytest.raises(ValueError):
            frame(engine, Join(how=how, on=on)(inputs))
    for bad in (lambda: Join(how="concat"), lambda: Join()({}), lambda: Join()({"__x": trades}), lambda: Join()({"minute": trades})):
        with pytest.raises(ValueError):
            bad()


def test_rolling(spark, tmp_path, engine):
    src = Source("trades_tbar", lookback_days=2)
    high, volume = Aggregate("1m", "max", value_col="price", alias="p")(src), metric("volume")(src)
    node = lambda **k: Project()(Op("rolling_corr", high, volume, alias="z", window=2, **k))
    made = {(r.date, r.minute): r.z for r in frame(engine, node(), ["20170104"]).df.collect()}
    across = {(r.date, r.minute): r.z for r in frame(engine, node(cross_day=True), ["20170104"]).df.collect()}
    assert made["20170104", 930] is None and across["20170104", 930] in (-1.0, 1.0)
    assert made["20170104", 931] == pytest.approx(1.0)
    assert all(-1 <= z <= 1 for z in across.values() if z is not None)
    for bad in ({"window": 0}, {"window": True}, {}):
        with pytest.raises(ValueError):
            Op("rolling_beta", high, volume, **bad)
    with pytest.raises(ValueError, match="cross_day"):
        frame(engine, Op("rolling_beta", high, volume, window=2, cross_day="yes"), ["20170104"])
    with pytest.raises(ValueError, match="two frames"):
        Op("rolling_beta", high, 3, window=2)


def test_lookback_copies_rows_after_aggregating(engine):
    days = [DATE, "20170104"]
    source = Source("trades_tbar", lookback_days=2)
    daily = Aggregate("1d", "sum", value_col="volume")(source)
    ratio = Project()(Op("div", daily, Aggregate("1d", "max", value_col="no")(source), alias="z"))
    made = frame(engine, ratio, days[1:])
    plan = made.df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda word: [k for k, line in enumerate(plan) if word in line]
    assert made.own_day == 0 and at("Join") and at("Aggregate") and max(at("Join")) < min(at("Aggregate"))
    each = {r.date: r.volume for d in days for r in frame(engine, Aggregate("1d", "sum", value_col="volume")(Source("trades_tbar")), [d]).df.collect()}
    both = frame(engine, daily, days[1:]).df.collect()
    assert {r.date: r.volume for r in both} == each and {r["__eval"] for r in both} == {"20170104"}


def test_lookbacks_that_differ_meet_by_evaluation_date(engine):
    long, short = (Aggregate("1d", "sum", value_col="volume")(Source("trades_tbar", lookback_days=k)) for k in (2, 1))
    rows = frame(engine, Join()({"a": long, "b": short}), ["20170104"]).df.collect()
    assert {r.date: r.b is None for r in rows} == {DATE: True, "20170104": False}
    assert [r.date for r in frame(engine, Project()(Op("add", long, short, alias="z")), ["20170104"]).df.collect()] == ["20170104"]


def test_a_filter_over_the_whole_lookback_sees_all_its_days(engine):
    top = Where(TopQuantile("volume", 1.0, over=("secu_code",)))
    seen = frame(engine, Source("trades_tbar", lookback_days=2), ["20170104"]).df.collect()
    best = max(r.volume for r in seen if r.volume is not None)
    kept = frame(engine, top(Source("trades_tbar", lookback_days=2)), ["20170104"]).df.collect()
    assert {r.volume for r in kept} == {best} and len(kept) == sum(r.volume == best for r in seen)


def test_lookback_needs_history(engine):
    with pytest.raises(ValueError, match="history"):
        frame(engine, Source("trades_tbar", lookback_days=2), [DATE])
    both = frame(engine, Source("trades_tbar", lookback_days=2), ["20170104"])
    assert both.df.count() == 10 and both.fields["volume"].lookback == 2
    assert both.df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r.date for r in both.df.select("date").collect()} == {DATE, "20170104"}


def test_evaluate_trace_and_profile(engine):
    vwap = Aggregate("1d", "mean")(FillNull("state")(metric("vwap")(SRC)))
    model = Model("m", "ex2kamt", {"value": vwap, "pre": Aggregate("1d", "first")(FillNull("state")(metric("preclose")(SRC)))})
    assert set(engine.evaluate_outputs(Model("x", None, {"v": metric("volume")(SRC)}), DATE)) == {"v"}
    steps = engine.trace(model, "2017-01-03")
    assert all(s.frame.count() >= 0 for s in steps) and len({s.resolved_name for s in steps}) == len(steps)
    assert engine.evaluate(model, vwap, DATE).columns == ["date", "secu_code", "vwap"]
    with engine.profiler() as outer:
        with engine.profiler() as inner:
            engine.collect(model, [DATE])
        with pytest.raises(ValueError):
            engine.collect(Model("m", "ex2kamt", {"value": metric("vwap")(SRC)}), [DATE])
    assert {"collect.start", "collect.end", "eval.cache_hit"} <= {e["event"] for e in inner.events} and "collect.error" in {e["event"] for e in outer.events}
    assert inner.to_frame(engine.spark).count() == len(inner.events)
    plan = engine.profile_plan([model, Model("n", "ex2kamt", {"value": vwap})])
    kept = plan.cache_candidates()
    assert kept and all(n.op != "source" and n.ref_count >= 2 for n in kept)
    assert plan.to_frame(engine.spark).count() == len(plan.nodes) and engine.profile_plan([]).to_frame(engine.spark).count() == 0


def test_declared_columns_are_the_real_ones(engine):
    nodes = [SRC, metric("vwap")(SRC), Grid()(metric("vwap")(SRC)), Aggregate("5m", "sum", apply_to="components")(metric("vwap")(SRC)), Join()({"a": metric("vwap")(SRC), "b": SRC})]
    for node in nodes:
        made = frame(engine, node)
        assert tuple(made.df.columns[1:]) == made.columns


def test_missing_files_and_bad_sources(spark, root, engine):
    with pytest.raises(FileNotFoundError):
        frame(engine, Source("cancels_tbar"))
    with pytest.raises(ValueError, match="identity keys"):
        frame(engine, Source("own_source"))
    write(spark, [(1, 1130, 1.0, 0, 1.0, 0.0, True, True, 1)], VENDOR, root / "data" / "cancels_tbar" / f"{DATE}.parquet")
    with pytest.raises(ValueError, match="1130"):
        frame(engine, Source("cancels_tbar"))
    write(spark, [(1, 1100)], "SecuCode long, MinBar long", root / "data" / "cancels_tbar" / f"{DATE}.parquet")
    with pytest.raises(ValueError, match="lacks columns"):
        frame(Engine(ParquetCatalog(spark, str(root / "data"))), Source("cancels_tbar"))


def test_own_operators_transforms_and_recipes(engine):
    @register_operator("double_volume")
    def lower(node, low):
        made = low.frame(node.inputs["input"])
        return Frame(made.df.withColumn("volume", made.df["volume"] * 2), made.keys, made.fields)

    assert at(engine, Node("double_volume", inputs={"input": metric("volume")(SRC)}))[930] == 30
    with pytest.raises(ValueError, match="registered"):
        register_operator("source")(lower)
    with pytest.raises(ValueError, match="no operator"):
        frame(engine, Node("nothing", inputs={"input": SRC}))
    with pytest.raises(ValueError):
        transform("rank")
    with pytest.raises(ValueError):
        metric("turnover")
    with pytest.raises(NotImplementedError):
        FactorRecipe().build()


def test_calendar():
    c = TradingCalendar(["2017-01-04", "20170103", "20170103"])
    assert c.previous_sessions("20170104", 2) == ["20170103", "20170104"]
