"""Registered queries: one for each operator, over the market-shaped tables, with DuckDB oracles.

Doubles are rounded in both engines, for sums and means depend on the order of rows in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom import vendor
from quantloom.bridge import CTES, market
from quantloom.engine import Engine
from quantloom.operators import (
    Aggregate, CancelsMinBar, Col, FillNull, Flag, Grid, Join, Op, Project, QuotesMinBar, Side, SnapshotMinBar, Source,
    Threshold, TopQuantile, TradesWithWaitBar, Where,
)
from quantloom.plans.frame import EVAL
from quantloom.plans.graph import Model, Node
from quantloom.recipes import last, metric

PLACES = 6
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

BARS = Source("trades_tbar")
DAY_OF_ORDERS = ["20240102"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, PLACES).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _steady(c: str, places: int) -> F.Column:
    """Rounding for quotients, which often lie just between two values: both engines go up there."""
    return F.floor(F.col(c) * 10**places + 0.5001) / float(10**places)


def _steady_sql(x: str, name: str, places: int) -> str:
    return f"floor(({x}) * {10**places} + 0.5001) / CAST({10**places} AS DOUBLE) AS {name}"


def _frame(engine: Engine, node: Node, dates: list[str], universe: str | None = "all", steady: tuple[str, int] | None = None) -> DataFrame:
    frame = engine.frame(Model("q", universe, {"value": node}), node, dates)
    public = [c for c in frame.columns if not c.startswith("__")]
    df = frame.df.where(F.col("date") == F.col(EVAL)).select(*public)
    return df.withColumn(steady[0], _steady(*steady)) if steady else _rounded(df)


def _node(name: str, node: Node, sql: str, dates: list[str] | None = None, steady: tuple[str, int] | None = None) -> None:
    """Register the frame of a node; sql follows the shared table expressions."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, sessions = market(spark, sf_dir)
        return _frame(engine, node, dates or sessions, steady=steady)

    _QUERIES[name], _ORACLES[name] = query, CTES + sql


def _r(x: str, name: str) -> str:
    return f"round({x}, {PLACES}) AS {name}"


# --- minutes as DuckDB sees them ----------------------------------------------------------------


def _bucket(m: str, n: int) -> str:
    """The positional bucket of a continuous minute, in integer arithmetic."""
    clock = f"(({m}) // 100 * 60 + ({m}) % 100)"
    index = f"(CASE WHEN {clock} < 720 THEN {clock} - 570 ELSE {clock} - 660 END)"
    first = f"({index} // {n} * {n})"
    back = f"(CASE WHEN {first} < 120 THEN {first} + 570 ELSE {first} + 660 END)"
    return f"CAST(CASE WHEN {m} IN (925, 1500) THEN {m} ELSE {back} // 60 * 100 + {back} % 60 END AS BIGINT)"


def _merged(n: int) -> str:
    return f"CASE WHEN minute = 925 THEN 930 WHEN minute = 1500 THEN {_bucket('1456', n)} ELSE minute END"


_TIES = "minute, price NULLS FIRST, side NULLS FIRST"
_DUCK = {
    "sum": "sum({c})", "mean": "avg({c})", "max": "max({c})", "min": "min({c})", "std": "stddev_samp({c})", "median": "median({c})",
    "first": "first({c} ORDER BY {t}, {c}) FILTER (WHERE {c} IS NOT NULL)", "last": "last({c} ORDER BY {t}, {c}) FILTER (WHERE {c} IS NOT NULL)",
}


def _agg(agg: str, column: str, ties: str = _TIES) -> str:
    return _DUCK[agg].format(c=column, t=ties)


# --- aggregation --------------------------------------------------------------------------------

for _name in _DUCK:
    _node(f"agg_1m_{_name}", Aggregate("1m", _name, value_col="volume")(BARS), f"SELECT date, secu_code, minute, {_r(_agg(_name, 'volume'), 'volume')} FROM trades_tbar GROUP BY ALL")
_node(
    "agg_5m_keep", Aggregate("5m", "sum", value_col="volume")(BARS),
    f"SELECT date, secu_code, {_bucket('minute', 5)} AS minute, {_r('sum(volume)', 'volume')} FROM trades_tbar GROUP BY 1, 2, 3",
)
_node(
    "agg_7m_drop", Aggregate("7m", "sum", value_col="volume", auction="drop")(BARS),
    f"SELECT date, secu_code, {_bucket('minute', 7)} AS minute, {_r('sum(volume)', 'volume')} FROM trades_tbar WHERE minute NOT IN (925, 1500) GROUP BY 1, 2, 3",
)
_node(
    "agg_15m_merge_last", Aggregate("15m", "last", value_col="price", alias="close", auction="merge")(BARS),
    f"SELECT date, secu_code, {_bucket('m', 15)} AS minute, {_r(_agg('last', 'price', 'om, price, side'), 'close')} "
    f"FROM (SELECT date, secu_code, price, side, minute AS om, {_merged(15)} AS m FROM trades_tbar) GROUP BY 1, 2, 3",
)
for _auction, _rows in (("keep", "true"), ("drop", "minute NOT IN (925, 1500)")):
    _node(
        f"agg_daily_{_auction}", Aggregate("1d", "mean", value_col="volume", auction=_auction)(BARS),
        f"SELECT date, secu_code, {_r('avg(volume)', 'volume')} FROM trades_tbar WHERE {_rows} GROUP BY 1, 2",
    )
_node(
    "agg_daily_merge", Aggregate("1d", "mean", value_col="volume", auction="merge")(BARS),
    f"SELECT date, secu_code, {_r('avg(v)', 'volume')} FROM (SELECT date, secu_code, {_merged(1)} AS m, avg(volume) AS v FROM trades_tbar GROUP BY 1, 2, 3) GROUP BY 1, 2",
)
_node("agg_flags", Aggregate("1d", "sum", value_col="is_last")(BARS), "SELECT date, secu_code, CAST(sum(CAST(is_last AS BIGINT)) AS BIGINT) AS is_last FROM trades_tbar GROUP BY 1, 2")

# --- metrics ------------------------------------------------------------------------------------

_BY_MINUTE = "FROM trades_tbar {w} GROUP BY date, secu_code, minute"
for _name, _value, _rows in (
    ("volume", "sum(volume)", ""), ("amount", "sum(price * volume)", ""), ("buyamount", "sum(price * volume)", "WHERE side = 0"),
    ("sellamount", "sum(price * volume)", "WHERE side = 1"), ("vwap", "sum(price * volume) / nullif(sum(volume), 0)", ""), ("high", "max(price)", ""), ("low", "min(price)", ""),
    ("open", "first(price ORDER BY price, side) FILTER (WHERE price IS NOT NULL)", "WHERE is_first"),
    ("close", "last(price ORDER BY price, side) FILTER (WHERE price IS NOT NULL)", "WHERE is_last"),
):
    _node(f"metric_{_name}", metric(_name)(BARS), f"SELECT date, secu_code, minute, {_r(_value, _name)} {_BY_MINUTE.format(w=_rows)}")
_node("metric_no", metric("no")(BARS), f"SELECT date, secu_code, minute, CAST(sum(no) AS BIGINT) AS no {_BY_MINUTE.format(w='')}")
_VWAP = metric("vwap")(BARS)
_MINUTE_SUMS = "SELECT date, secu_code, minute, sum(price * volume) AS a, sum(volume) AS v FROM trades_tbar GROUP BY 1, 2, 3"
_node(
    "vwap_components_5m", Project()(Aggregate("5m", "sum", apply_to="components")(_VWAP)),
    f"SELECT date, secu_code, {_bucket('minute', 5)} AS minute, {_r('sum(a) / nullif(sum(v), 0)', 'vwap')} FROM ({_MINUTE_SUMS}) GROUP BY 1, 2, 3",
)
_node(
    "vwap_field_5m", Aggregate("5m", "mean")(_VWAP),
    f"SELECT date, secu_code, {_bucket('minute', 5)} AS minute, {_steady_sql('avg(a / nullif(v, 0))', 'vwap', 5)} FROM ({_MINUTE_SUMS}) GROUP BY 1, 2, 3",
    steady=("vwap", 5),
)

# --- columns and arithmetic ---------------------------------------------------------------------

_BAR_COLUMNS = "date, secu_code, minute, price, side"
_node("scan_normalise", BARS, f"SELECT secu_code, minute, {_r('price', 'price')}, side, {_r('volume', 'volume')}, vw_wait_time, is_first, is_last, no, date FROM trades_tbar")
_node("project", Project()(Col("volume").alias("lot")(BARS)), f"SELECT {_BAR_COLUMNS.replace('price', _r('price', 'price'))}, {_r('volume', 'volume')}, vw_wait_time, is_first, is_last, no, {_r('volume', 'lot')} FROM trades_tbar")
_node(
    "row_op", Aggregate("1m", "sum", value_col="x")(((Col("price") * Col("volume") - 1) / (Col("volume") - 3)).alias("x")(BARS)),
    f"SELECT date, secu_code, minute, {_r('sum((price * volume - 1) / nullif(volume - 3, 0))', 'x')} FROM trades_tbar GROUP BY 1, 2, 3",
)
_A = "SELECT date, secu_code, minute, sum(volume) AS x FROM trades_tbar GROUP BY 1, 2, 3"
_B = "SELECT date, secu_code, minute, sum(price * volume) AS y FROM trades_tbar WHERE side = 0 GROUP BY 1, 2, 3"
for _name, _expr in (("add", "x + y"), ("sub", "x - y"), ("mul", "x * y"), ("div", "x / nullif(y, 0)")):
    _node(f"frame_op_{_name}", Project()(Op(_name, metric("volume")(BARS), metric("buyamount")(BARS), alias="z")), f"SELECT date, secu_code, minute, {_r(_expr, 'z')} FROM ({_A}) JOIN ({_B}) USING (date, secu_code, minute)")
_node(
    "frame_op_fused", Project()(Op("sub", metric("high")(BARS), metric("low")(BARS), alias="z")),
    f"SELECT date, secu_code, minute, {_r('max(price) - min(price)', 'z')} FROM trades_tbar GROUP BY 1, 2, 3",
)
_node("scalar_op", Project()((2 * metric("volume")(BARS) - 1).alias("z")), f"SELECT date, secu_code, minute, {_r('2 * x - 1', 'z')} FROM ({_A})")
_node("rename", Project()(Project()(metric("volume")(BARS)).alias("lots")), f"SELECT date, secu_code, minute, {_r('x', 'lots')} FROM ({_A})")

# --- filters ------------------------------------------------------------------------------------

_COUNTED = "SELECT date, secu_code, minute, CAST(sum(no) AS BIGINT) AS no FROM trades_tbar WHERE {w} GROUP BY 1, 2, 3"
for _name, _condition, _rows in (
    ("side", Side("sell"), "side = 1"), ("flag", Flag("is_first"), "coalesce(is_first, false)"),
    ("threshold", Threshold("volume", op=">=", value=5), "volume >= 5"),
):
    _node(f"where_{_name}", Aggregate("1m", "sum", value_col="no")(Where(_condition)(BARS)), _COUNTED.format(w=_rows))
_node("last_minute", Aggregate("1m", "sum", value_col="no")(last(1430)(BARS)), _COUNTED.format(w="minute >= 1430"))
_node(
    "top_quantile", Aggregate("1d", "sum", value_col="volume")(Where(TopQuantile("volume", q=0.7, over=["date", "secu_code"]))(BARS)),
    "SELECT t.date, t.secu_code, round(sum(volume), 6) AS volume FROM trades_tbar t JOIN (SELECT date, secu_code, "
    "list_sort(list(volume) FILTER (WHERE volume IS NOT NULL))[CAST(round((count(volume) - 1) * CAST(0.7 AS DOUBLE)) AS BIGINT) + 1] AS low FROM trades_tbar GROUP BY 1, 2) q "
    "ON t.date = q.date AND t.secu_code = q.secu_code AND t.volume >= q.low GROUP BY 1, 2",
)

for _name, _op, _duck in (("gt", ">", ">"), ("lt", "<", "<"), ("le", "<=", "<="), ("eq", "==", "="), ("eq_single", "=", "="), ("ne", "!=", "<>"), ("ne_sql", "<>", "<>")):
    _node(f"where_threshold_{_name}", Aggregate("1m", "sum", value_col="no")(Where(Threshold("volume", op=_op, value=5))(BARS)), _COUNTED.format(w=f"volume {_duck} 5"))
for _name, _q, _best in (("lowest", 0, "min"), ("highest", 1, "max")):
    _node(
        f"top_quantile_{_name}", Aggregate("1d", "sum", value_col="no")(Where(TopQuantile("volume", q=_q))(BARS)),
        f"SELECT t.date, t.secu_code, CAST(sum(no) AS BIGINT) AS no FROM trades_tbar t JOIN (SELECT date, secu_code, {_best}(volume) AS low FROM trades_tbar GROUP BY 1, 2) q "
        "ON t.date = q.date AND t.secu_code = q.secu_code AND t.volume >= q.low GROUP BY 1, 2",
    )
_node("agg_flags_mean", Aggregate("1d", "mean", value_col="is_last")(BARS), f"SELECT date, secu_code, {_r('avg(CAST(is_last AS BIGINT))', 'is_last')} FROM trades_tbar GROUP BY 1, 2")

# --- joins and grids ----------------------------------------------------------------------------

_VOLUME, _BUYS = metric("volume")(BARS), metric("buyamount")(BARS)
_node("join_full", Join()({"buys": _BUYS, "lots": _VOLUME}), f"SELECT date, secu_code, minute, {_r('y', 'buys')}, {_r('x', 'lots')} FROM ({_B}) FULL JOIN ({_A}) USING (date, secu_code, minute)")
_node("join_left", Join(how="left")({"buys": _BUYS, "lots": _VOLUME}), f"SELECT date, secu_code, minute, {_r('y', 'buys')}, {_r('x', 'lots')} FROM ({_B}) LEFT JOIN ({_A}) USING (date, secu_code, minute)")
_node(
    "join_left_daily", Join(how="left", on=("date", "secu_code"))({"lots": _VOLUME, "day": Aggregate("1d", "max")(_VOLUME)}),
    f"SELECT date, secu_code, minute, {_r('x', 'lots')}, {_r('day', 'day')} FROM ({_A}) LEFT JOIN (SELECT date, secu_code, max(x) AS day FROM ({_A}) GROUP BY 1, 2) USING (date, secu_code)",
)

_SELLS = metric("sellamount")(BARS)
_S = "SELECT date, secu_code, minute, sum(price * volume) AS s FROM trades_tbar WHERE side = 1 GROUP BY 1, 2, 3"
_node(
    "join_full_three", Join()({"buys": _BUYS, "sells": _SELLS, "lots": _VOLUME}),
    f"SELECT date, secu_code, minute, {_r('y', 'buys')}, {_r('s', 'sells')}, {_r('x', 'lots')} FROM ({_B}) FULL JOIN ({_S}) USING (date, secu_code, minute) FULL JOIN ({_A}) USING (date, secu_code, minute)",
)
_node(
    "join_shared_keys", Join(how="left", on="identity_intersection")({"lots": _VOLUME, "buys": _BUYS, "day": Aggregate("1d", "max")(_VOLUME)}),
    f"SELECT date, secu_code, minute, {_r('x', 'lots')}, {_r('y', 'buys')}, {_r('day', 'day')} FROM ({_A}) LEFT JOIN ({_B}) USING (date, secu_code, minute) "
    f"LEFT JOIN (SELECT date, secu_code, max(x) AS day FROM ({_A}) GROUP BY 1, 2) USING (date, secu_code)",
)


def _grid_sql(buckets: str, auctions: str, factor: str) -> str:
    minutes = f"SELECT DISTINCT {buckets} AS minute FROM (SELECT CASE WHEN k < 120 THEN (570 + k) // 60 * 100 + (570 + k) % 60 ELSE (660 + k) // 60 * 100 + (660 + k) % 60 END AS minute FROM range(237) r(k)) {auctions}"
    return f"SELECT date, secu_code, minute, {factor} FROM (SELECT u.date, u.secu_code, CAST(m.minute AS BIGINT) AS minute FROM universe u CROSS JOIN ({minutes}) m) g "


_WITH_AUCTIONS = "UNION SELECT 925 UNION SELECT 1500"
_node("grid_1m", Grid()(_VOLUME), _grid_sql("minute", _WITH_AUCTIONS, _r("x", "volume")) + f"LEFT JOIN ({_A}) USING (date, secu_code, minute)")
_FIVE = f"SELECT date, secu_code, {_bucket('minute', 5)} AS minute, sum(volume) AS x FROM trades_tbar WHERE minute NOT IN (925, 1500) GROUP BY 1, 2, 3"
_node("grid_5m", Grid()(Aggregate("5m", "sum", value_col="volume", auction="drop")(BARS)), _grid_sql(_bucket("minute", 5), "", _r("x", "volume")) + f"LEFT JOIN ({_FIVE}) USING (date, secu_code, minute)")
_node(
    "grid_daily_broadcast", Grid("5m", auction="keep")(Aggregate("1d", "sum", value_col="volume")(BARS)),
    _grid_sql(_bucket("minute", 5), _WITH_AUCTIONS, _r("x", "volume")) + "LEFT JOIN (SELECT date, secu_code, sum(volume) AS x FROM trades_tbar GROUP BY 1, 2) USING (date, secu_code)",
)

# --- filling ------------------------------------------------------------------------------------

_CLOSE = "SELECT date, secu_code, minute, last(price ORDER BY price, side) FILTER (WHERE price IS NOT NULL) AS close FROM trades_tbar WHERE is_last GROUP BY 1, 2, 3"
_V = "SELECT date, secu_code, minute, sum(price * volume) / nullif(sum(volume), 0) AS x FROM trades_tbar GROUP BY 1, 2, 3"
_SO_FAR = "OVER (PARTITION BY date, secu_code ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_node("fill_numeric", FillNull(0)(metric("vwap")(BARS)), f"SELECT date, secu_code, minute, {_r('coalesce(x, 0)', 'vwap')} FROM ({_V})")
_node("fill_ffill", FillNull("ffill")(metric("close")(BARS)), f"SELECT date, secu_code, minute, {_r(f'last_value(close IGNORE NULLS) {_SO_FAR}', 'close')} FROM ({_CLOSE})")
_STATE = (
    f"SELECT date, secu_code, minute, coalesce(last_value(close IGNORE NULLS) {_SO_FAR}, preclose) AS state, preclose "
    "FROM (SELECT k.date, k.secu_code, k.minute, c.close, d.preclose FROM ({keys}) k "
    f"LEFT JOIN ({_CLOSE}) c USING (date, secu_code, minute) LEFT JOIN daily_k d USING (date, secu_code))"
)
_node(
    "fill_state", FillNull("state")(metric("vwap")(BARS)),
    f"SELECT date, secu_code, minute, {_r('coalesce(x, state)', 'vwap')} FROM ({_V}) JOIN ({_STATE.format(keys=f'SELECT date, secu_code, minute FROM ({_V})')}) USING (date, secu_code, minute)",
)
_node(
    "fill_state_grid", FillNull("state")(Grid()(metric("close")(BARS))),
    f"SELECT date, secu_code, minute, {_r('state', 'close')} FROM ({_STATE.format(keys=_grid_sql('minute', _WITH_AUCTIONS, '0 AS z'))})",
)
_node(
    "preclose_state", FillNull("state")(metric("preclose")(BARS)),
    "SELECT date, secu_code, minute, " + _r("coalesce(lag(state) OVER (PARTITION BY date, secu_code ORDER BY minute), preclose)", "preclose")
    + f" FROM ({_STATE.format(keys=f'SELECT date, secu_code, minute FROM ({_CLOSE})')})",
)

# --- rolling ------------------------------------------------------------------------------------


def _rolling_sql(name: str, rows: str, keys: str, group: str, order: str, n: int) -> str:
    over = f"OVER (PARTITION BY {group} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    mean = lambda c, a: f"CASE WHEN count({c}) {over} = {n} THEN avg({c}) {over} END AS {a}"
    moments = ", ".join(mean(c, a) for c, a in (("y", "my"), ("x", "mx"), ("x * y", "mxy"), ("x * x", "mxx"), ("y * y", "myy")))
    slope = "CASE WHEN mxx - mx * mx > 0 THEN (mxy - my * mx) / (mxx - mx * mx) END"
    value = {
        "rolling_beta": slope,
        "rolling_alpha": f"my - ({slope}) * mx",
        "rolling_corr": "CASE WHEN mxx - mx * mx > 0 AND myy - my * my > 0 THEN greatest(-1.0, least(1.0, (mxy - my * mx) / (sqrt(mxx - mx * mx) * sqrt(myy - my * my)))) END",
    }[name]
    return f"SELECT {keys}, {_steady_sql(value, 'z', 3)} FROM (SELECT {keys}, {moments} FROM ({rows}))"


def _rolling(name: str, op: str, y: Node, x: Node, sql: str, **params) -> None:
    """Rolling moments cancel, so their results agree to fewer places."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, sessions = market(spark, sf_dir)
        days = sessions[params.get("lookback", 1) - 1 :]
        node = Project()(Op(op, y, x, alias="z", window=params["window"], **({"cross_day": True} if params.get("cross_day") else {})))
        return _frame(engine, node, days, steady=("z", 3))

    _QUERIES[name], _ORACLES[name] = query, CTES + sql


_XY = "SELECT date, secu_code, minute, max(price) AS y, max(volume) AS x FROM trades_tbar GROUP BY 1, 2, 3"
_HIGH, _LOTS = metric("high")(BARS), Aggregate("1m", "max", value_col="volume")(BARS)
for _op in ("rolling_corr", "rolling_beta", "rolling_alpha"):
    _rolling(_op, _op, _HIGH, _LOTS, _rolling_sql(_op, _XY, "date, secu_code, minute", "date, secu_code", "minute", 5), window=5)
_LONG = Source("trades_tbar", lookback_days=3)
_EVALS = "SELECT date AS e, lag(date, 2) OVER (ORDER BY date) AS first_date FROM (SELECT DISTINCT date FROM universe)"
_SEEN = f"SELECT e.e, t.* FROM ({_XY}) t JOIN ({_EVALS}) e ON t.date BETWEEN e.first_date AND e.e"
_rolling(
    "rolling_corr_cross_day", "rolling_corr", metric("high")(_LONG), Aggregate("1m", "max", value_col="volume")(_LONG),
    "SELECT date, secu_code, minute, z FROM (" + _rolling_sql("rolling_corr", _SEEN, "e, date, secu_code, minute", "e, secu_code", "date, minute", 8) + ") WHERE e = date",
    window=8, cross_day=True, lookback=3,
)
_DAYS = "SELECT date, secu_code, max(price) AS y, max(volume) AS x FROM trades_tbar GROUP BY 1, 2"
_LONG5 = Source("trades_tbar", lookback_days=5)
_rolling(
    "rolling_beta_daily", "rolling_beta", Aggregate("1d", "mean", value_col="price", alias="p")(_LONG5), Aggregate("1d", "mean", value_col="volume")(_LONG5),
    "SELECT date, secu_code, z FROM (" + _rolling_sql(
        "rolling_beta", "SELECT e.e, t.* FROM (SELECT date, secu_code, avg(price) AS y, avg(volume) AS x FROM trades_tbar GROUP BY 1, 2) t "
        "JOIN (SELECT date AS e, lag(date, 4) OVER (ORDER BY date) AS first_date FROM (SELECT DISTINCT date FROM universe)) e ON t.date BETWEEN e.first_date AND e.e",
        "e, date, secu_code", "e, secu_code", "date", 5) + ") WHERE e = date",
    window=5, lookback=5,
)


def _lookback_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, sessions = market(spark, sf_dir)
    frame = engine.frame(Model("q", None, {"value": _LONG}), _LONG, sessions[2:])
    return frame.df.groupBy(F.col(EVAL).alias("eval_date"), "date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), PLACES).alias("volume"))


_QUERIES["lookback_scan"] = _lookback_scan
_ORACLES["lookback_scan"] = CTES + f"SELECT e.e AS eval_date, t.date, count(*) AS n, round(sum(t.volume), 6) AS volume FROM trades_tbar t JOIN ({_EVALS}) e ON t.date BETWEEN e.first_date AND e.e GROUP BY 1, 2"

# --- order-flow bars ----------------------------------------------------------------------------

_MS = "(({t}) // 10000000 * 3600000 + ({t}) // 100000 % 100 * 60000 + ({t}) // 1000 % 100 * 1000 + ({t}) % 1000)"


def _wait(later: str, earlier: str) -> str:
    b, a = _MS.format(t=later), _MS.format(t=earlier)
    ms = f"({b} - {a} - CASE WHEN {b} > 41460000 AND {a} <= 41460000 THEN 5400000 ELSE 0 END)"
    return f"CASE WHEN {ms} >= 0 THEN {ms} / 1000.0 END"


def _bars_sql(events: str, order: str, waits: bool) -> str:
    minute = "CAST(CASE WHEN tm < 93000000 THEN 925 WHEN tm >= 145700000 THEN 1500 WHEN tm < 130000000 THEN least(tm, 112959999) // 100000 ELSE tm // 100000 END AS BIGINT)"
    wait = "round(CASE WHEN coalesce(sum(volume), 0) = 0 THEN 'nan'::DOUBLE ELSE coalesce(sum(volume * wait), 0) / sum(volume) END, 6) AS vw_wait_time, " if waits else ""
    ranked = f"SELECT *, {minute} AS minute, row_number() OVER (ORDER BY {order}) AS r FROM ({events})"
    grouped = f"SELECT date, secu_code, minute, price, side, round(coalesce(sum(volume), 0), 6) AS volume, {wait}min(r) AS f, max(r) AS l, count(volume) AS no FROM ({ranked}) GROUP BY date, secu_code, minute, price, side"
    by = "OVER (PARTITION BY date, secu_code, minute)"
    return f"SELECT date, secu_code, minute, price, side, volume, {'vw_wait_time, ' if waits else ''}f = min(f) {by} AS is_first, l = max(l) {by} AS is_last, no FROM ({grouped})"


_TRADES, _ORDERS = Source("steptrades"), Source("steporders")
_PLACED = "(SELECT secu_code, order_id, order_time AS placed FROM steporders WHERE order_type NOT IN (-1, -11))"
_CODED = ("(SELECT date, secu_code, deal_time, buy_id, sell_id, deal_id, price, volume, side FROM steptrades)", "(SELECT * FROM steporders)")
_node(
    "trades_wait_bar", TradesWithWaitBar()(_TRADES, _ORDERS),
    _bars_sql(
        f"SELECT t.date, t.secu_code, t.deal_time AS tm, t.deal_id, round(t.price / 100, 6) AS price, t.side, CAST(t.volume AS DOUBLE) AS volume, {_wait('t.deal_time', 'o.placed')} AS wait "
        f"FROM steptrades t LEFT JOIN {_PLACED} o ON o.secu_code = t.secu_code AND o.order_id = least(t.buy_id, t.sell_id) WHERE t.side IN (0, 1)",
        "tm, deal_id, price, side", True),
    DAY_OF_ORDERS,
)
_SZ_FILL = "(SELECT secu_code, {who}_id AS order_id, {best}(price) AS {who} FROM steptrades WHERE secu_code < 600000 AND side IN (0, 1) GROUP BY 1, 2)"
_ROW = "{s}.secu_code, {s}.date, {at} AS tm, {price} AS price, CAST({s}.volume AS DOUBLE) AS volume, {oid} AS order_id, {side} AS side"
_SZ_QUOTES = (
    "SELECT " + _ROW.format(s="o", at="o.order_time", price="o.price / 100", oid="o.order_id", side="CASE o.order_type WHEN 2 THEN 0 ELSE 1 END") + " FROM steporders o WHERE order_type IN (2, 12) UNION ALL SELECT "
    + _ROW.format(s="o", at="o.order_time", price="coalesce(b.buy, s.sell) / 100", oid="o.order_id", side="CASE WHEN o.order_type IN (1, 3) THEN 0 ELSE 1 END")
    + f" FROM steporders o LEFT JOIN {_SZ_FILL.format(who='buy', best='max')} b USING (secu_code, order_id) LEFT JOIN {_SZ_FILL.format(who='sell', best='min')} s USING (secu_code, order_id) "
    "WHERE o.order_type IN (1, 3, 11, 13) AND coalesce(b.buy, s.sell) IS NOT NULL"
)
_QUOTES = (
    _SZ_QUOTES + " UNION ALL SELECT " + _ROW.format(s="o", at="o.order_time", price="o.price / 100", oid="o.order_id", side="CASE o.order_type WHEN 0 THEN 0 ELSE 1 END") + " FROM steporders o WHERE order_type IN (0, 10) "
    "UNION ALL SELECT " + _ROW.format(s="t", at="t.deal_time", price="t.price / 100", oid="greatest(t.buy_id, t.sell_id)", side="t.side") + " FROM steptrades t WHERE t.secu_code >= 600000 AND t.deal_time BETWEEN 93000000 AND 145710000"
)
_EVENT_ORDER = "tm, order_id, CASE WHEN side = 0 THEN price ELSE -price END, side"
_SIDE = "SELECT * REPLACE (CAST(side AS BIGINT) AS side, round(price, 6) AS price) FROM ({q})"
_node("quotes_bar", QuotesMinBar()(_TRADES, _ORDERS), _bars_sql(_SIDE.format(q=_QUOTES), _EVENT_ORDER, False), DAY_OF_ORDERS)
_CANCELS = (
    "SELECT " + _ROW.format(s="t", at="t.deal_time", price="q.price", oid="t.buy_id + t.sell_id", side="CASE t.side WHEN -1 THEN 0 ELSE 1 END")
    + f" FROM steptrades t JOIN ({_SZ_QUOTES}) q ON q.secu_code = t.secu_code AND q.order_id = t.buy_id + t.sell_id WHERE t.secu_code < 600000 AND t.side IN (-1, -11) AND q.price IS NOT NULL UNION ALL SELECT "
    + _ROW.format(s="o", at="o.order_time", price="o.price / 100", oid="o.order_id", side="CASE o.order_type WHEN -1 THEN 0 ELSE 1 END") + " FROM steporders o WHERE order_type IN (-1, -11)"
)
_node(
    "cancels_bar", CancelsMinBar()(_TRADES, _ORDERS),
    _bars_sql(f"SELECT c.*, {_wait('c.tm', 'o.placed')} AS wait FROM ({_SIDE.format(q=_CANCELS)}) c LEFT JOIN {_PLACED} o USING (secu_code, order_id)", _EVENT_ORDER, True),
    DAY_OF_ORDERS,
)


def _book_sql(source: str, zero: bool) -> str:
    """The filled order book: null (and zero) prices from the other side at the top, then from above."""
    p = lambda s, k: f"nullif(CAST({s}Price{k} AS DOUBLE), 0)" if zero else f"{s}Price{k}"
    new = []
    for s, o in (("Ask", "Bid"), ("Bid", "Ask")):
        for k in range(1, 11):
            new.append(f"coalesce({', '.join([p(s, j) for j in range(k, 0, -1)] + [p(o, 1)])}) AS {s}Price{k}")
            new.append(f"coalesce({s}Volume{k}, 0) AS {s}Volume{k}")
    return f"SELECT * REPLACE ({', '.join(new)}) FROM ({source})"


def _snapshot_sql() -> str:
    live = "SELECT * FROM orderbook WHERE tick_time BETWEEN 93000000 AND 112999999 OR tick_time BETWEEN 130000000 AND 145699999"
    w = "OVER (PARTITION BY date, secu_code ORDER BY tick_time)"
    flow = []
    for k in range(1, 6):
        b, a, sb, sa = f"BidPrice{k}", f"AskPrice{k}", f"ln(BidVolume{k} * BidPrice{k} + 1)", f"ln(AskVolume{k} * AskPrice{k} + 1)"
        flow.append(
            f"CAST({b} <= lag({b}) {w} AS INT) * {sb} - CAST({b} = lag({b}) {w} AS INT) * lag({sb}) {w} "
            f"- CAST({a} >= lag({a}) {w} AS INT) * {sa} + CAST({a} = lag({a}) {w} AS INT) * lag({sa}) {w} AS aVOI{k}"
        )
    ticks = f"SELECT *, {', '.join(flow)} FROM ({_book_sql(live, True)})"
    sides = ("Ask", "Bid")
    means = [f"avg({s}Price{k}) / 100 AS {s}Price{k}" for s in sides for k in range(1, 11)] + [f"avg({s}Volume{k}) AS {s}Volume{k}" for s in sides for k in range(1, 11)]
    means += [f"coalesce(sum(aVOI{k}), 0) AS aVOI{k}" for k in range(1, 6)]
    bars = f"SELECT date, secu_code, tick_time // 100000 AS minute, {', '.join(means)} FROM ({ticks}) GROUP BY 1, 2, 3"
    cells = f"SELECT date, secu_code, minute FROM (SELECT DISTINCT date, secu_code FROM ({bars})) JOIN (SELECT DISTINCT date, minute FROM ({bars})) USING (date)"
    aux = "SELECT date, secu_code, arg_max(price, tick_time) AS aux FROM orderbook WHERE tick_time <= 93000000 AND price <> 0 GROUP BY 1, 2"
    over = "OVER (PARTITION BY date, secu_code ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    top = ", ".join(f"coalesce(last_value({s}Price1 IGNORE NULLS) {over}, aux) AS {s}Price1" for s in sides)
    whole = f"SELECT * EXCLUDE (aux) REPLACE ({top}) FROM ({cells}) LEFT JOIN ({bars}) USING (date, secu_code, minute) LEFT JOIN ({aux}) USING (date, secu_code)"
    names = [f"{s}{kind}{k}" for s in sides for kind in ("Price", "Volume") for k in range(1, 11)]
    shown = [f"round({c}, 6) AS {c}" for c in names] + [f"round(coalesce(aVOI{k}, 0), 6) AS aVOI{k}" for k in range(1, 6)]
    return f"SELECT date, secu_code, minute, {', '.join(shown)} FROM ({_book_sql(whole, True)})"


_node("snapshot_bar", SnapshotMinBar()(Source("orderbook")), _snapshot_sql())

# --- daily factors ------------------------------------------------------------------------------

CLOSE_LAST = Model("close_last", "all", {"value": Aggregate("1d", "last")(metric("close")(BARS))})
DAILY = Model("daily", "all", {"volume": Aggregate("1d", "sum")(_VOLUME), "vwap": Project()(Aggregate("1d", "sum", apply_to="components")(_VWAP))})
LATE = Model("late", "all", {"value": Aggregate("1d", "sum")(Where(Threshold("minute", ">=", 1400))(_VOLUME))})


def _collect(*models: Model) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, sessions = market(spark, sf_dir)
        return _rounded(engine.collect(models[0], sessions) if len(models) == 1 else engine.collect_many(models, sessions))

    return query


def _factor_sql(name: str, rows: str) -> str:
    return f"SELECT u.date, u.secu_code, '{name}' AS factor_name, round(CAST(f.value AS DOUBLE), 6) AS value FROM universe u LEFT JOIN ({rows}) f USING (date, secu_code)"


_CLOSE_SQL = _factor_sql("close_last", f"SELECT date, secu_code, last(close ORDER BY minute) FILTER (WHERE close IS NOT NULL) AS value FROM ({_CLOSE}) GROUP BY 1, 2")
_DAILY_SQL = " UNION ALL ".join([
    _factor_sql("daily__volume", f"SELECT date, secu_code, sum(x) AS value FROM ({_A}) GROUP BY 1, 2"),
    _factor_sql("daily__vwap", f"SELECT date, secu_code, sum(a) / nullif(sum(v), 0) AS value FROM ({_MINUTE_SUMS}) GROUP BY 1, 2"),
])
_LATE_SQL = _factor_sql("late", f"SELECT date, secu_code, sum(x) AS value FROM ({_A}) WHERE minute >= 1400 GROUP BY 1, 2")
_QUERIES |= {"close_last": _collect(CLOSE_LAST), "union_outputs": _collect(DAILY), "collect_many": _collect(CLOSE_LAST, DAILY, LATE)}
_ORACLES |= {"close_last": CTES + _CLOSE_SQL, "union_outputs": CTES + _DAILY_SQL, "collect_many": CTES + " UNION ALL ".join([_CLOSE_SQL, _DAILY_SQL, _LATE_SQL])}


def queries() -> dict[str, Query]:
    return _QUERIES | vendor.queries()


def oracle_sql() -> dict[str, str]:
    return _ORACLES | vendor.oracle_sql()
