"""Order-flow and order-book bars on hand-made events."""

import math

import pytest
from pyspark.sql import functions as F

from quantloom import CancelsMinBar, Engine, Model, QuotesMinBar, SnapshotMinBar, Source, TableCatalog, TradesWithWaitBar
from quantloom.functions.scalars import bar_minute, clock_ms, session_wait
from quantloom.sources.contracts import COLUMNS

DATE = "20200102"
TRADES = "date string, secu_code long, deal_time long, buy_id long, sell_id long, deal_id long, price long, volume double, side long"
ORDERS = "date string, secu_code long, order_time long, order_id long, order_type long, price long, volume double"


def run(spark, node, date=DATE, **tables):
    engine = Engine(TableCatalog(spark, tables, [date]))
    return engine.frame(Model("m", None, {"value": node}), node, [date]).df.drop("__eval").collect()


def market(spark, builder, trades, orders, date=DATE):
    return run(
        spark, builder()(Source("steptrades"), Source("steporders")), date,
        steptrades=spark.createDataFrame([(date, *t) for t in trades], TRADES), steporders=spark.createDataFrame([(date, *o) for o in orders], ORDERS),
    )


def test_clock(spark):
    rows = spark.createDataFrame([(93000123, 93000000), (130030000, 113000000), (93000000, 93000001), (None, 1)], "b long, a long")
    got = rows.select(clock_ms(F.col("b")).alias("ms"), session_wait(F.col("b"), F.col("a")).alias("w"), bar_minute(F.col("b")).alias("m")).collect()
    assert [r.ms for r in got] == [34200123, 46830000, 34200000, None] and [r.w for r in got] == [0.123, 30.0, None, None]
    times = [92500000, 93000000, 112959999, 120000000, 130000000, 145659999, 145700000, 150000000]
    bars = spark.createDataFrame([(t,) for t in times], "t long").select(bar_minute(F.col("t")).alias("m")).collect()
    assert [r.m for r in bars] == [925, 930, 1129, 1129, 1300, 1456, 1500, 1500]


def test_trades_with_wait(spark):
    trades = [(1, 93001000, 11, 21, 1, 1000, 10.0, 0), (1, 93002000, 12, 22, 2, 1000, 30.0, 0), (1, 93003000, 13, 23, 3, 1010, 5.0, 1), (1, 92500000, 14, None, 4, 990, 1.0, 0), (1, 93004000, 15, 25, 5, 1000, 9.0, -1)]
    orders = [(1, 93000000, 11, 0, 1000, 10.0), (1, 92958000, 12, 0, 1000, 1.0), (1, 92958000, 12, -1, 1000, 1.0)]
    got = {(r.minute, r.price, r.side): r for r in market(spark, TradesWithWaitBar, trades, orders)}
    assert set(got) == {(930, 10.0, 0), (930, 10.1, 1), (925, 9.9, 0)}
    r = got[930, 10.0, 0]
    assert (r.volume, r.no, r.vw_wait_time, r.is_first, r.is_last) == (40.0, 2, (10 * 1 + 30 * 4) / 40, True, False)
    assert got[930, 10.1, 1].vw_wait_time == 0.0 and got[930, 10.1, 1].is_last and got[925, 9.9, 0].is_first


def test_zero_volume_wait_is_nan(spark):
    r = market(spark, TradesWithWaitBar, [(1, 93001000, 11, 21, 1, 1000, 0.0, 0), (1, 93001000, 11, 21, 2, 1010, None, 0)], [])
    assert all(math.isnan(x.vw_wait_time) for x in r) and {x.volume for x in r} == {0.0} and sorted(x.no for x in r) == [0, 1]


def test_sh_quotes_and_cancels(spark):
    orders = [(600001, 93000000, 1, 0, 1000, 10.0), (600001, 93001000, 2, 10, 1010, 20.0), (600001, 93010000, 1, -1, 990, 3.0), (600001, 93020000, 2, -11, 1020, 4.0)]
    trades = [(600001, 145720000, 1, 2, 9, 1000, 7.0, 0), (600001, 100000000, 5, 4, 10, 1000, 7.0, 1)]
    quotes = {(r.minute, r.price, r.side): r.volume for r in market(spark, QuotesMinBar, trades, orders)}
    assert quotes == {(930, 10.0, 0): 10.0, (930, 10.1, 1): 20.0, (1000, 10.0, 1): 7.0}
    old = {(r.minute, r.price, r.side) for r in market(spark, QuotesMinBar, trades, orders, "20180817")}
    assert (1500, 10.0, 0) in old
    cancels = {(r.price, r.side): (r.volume, r.vw_wait_time) for r in market(spark, CancelsMinBar, trades, orders)}
    assert cancels == {(9.9, 0): (3.0, 10.0), (10.2, 1): (4.0, 19.0)}


def test_sz_prices_are_discovered(spark):
    orders = [(1, 93000000, 21, 2, 1000, 10.0), (1, 93000500, 22, 1, 0, 20.0), (1, 93000600, 23, 11, 0, 5.0), (1, 93000700, 24, 3, 0, 5.0)]
    trades = [(1, 93001000, 22, 30, 1, 1004, 5.0, 0), (1, 93001000, 22, 31, 2, 1005, 5.0, 0), (1, 93002000, 40, 23, 3, 998, 5.0, 1), (1, 93002001, 41, 23, 4, 997, 5.0, 1), (1, 93100500, 22, 0, 5, 0, 10.0, -1), (1, 93100500, 77, 0, 6, 0, 10.0, -1)]
    quotes = {(r.price, r.side): r for r in market(spark, QuotesMinBar, trades, orders)}
    assert set(quotes) == {(10.0, 0), (10.05, 0), (9.97, 1)} and quotes[10.0, 0].is_first and quotes[9.97, 1].is_last
    cancels = market(spark, CancelsMinBar, trades, orders)
    assert [(r.price, r.side, r.vw_wait_time) for r in cancels] == [(10.05, 0, 60.0)]


def test_codes_are_cleaned(spark):
    trades = [(22, 93001000, 1, 2, 1, 1000, 1.0, 0), (800001, 93001000, 1, 2, 1, 1000, 1.0, 0)]
    assert [r.secu_code for r in market(spark, TradesWithWaitBar, trades, [])] == [1872]


def test_snapshot(spark):
    names = COLUMNS["orderbook"]

    def tick(code, time, price, bid, ask, volume=100.0):
        row = {"secu_code": code, "date": DATE, "tick_time": time, "price": price}
        for k in range(1, 11):
            row |= {f"AskPrice{k}": ask + k - 1 if ask and k < 3 else 0, f"BidPrice{k}": bid - k + 1 if bid and k < 3 else 0, f"AskVolume{k}": volume, f"BidVolume{k}": None if k > 5 else volume}
        return tuple(row[n] for n in names)

    schema = ", ".join(f"{n} {'string' if n == 'date' else 'double' if 'Volume' in n else 'long'}" for n in names)
    ticks = [tick(1, 92500000, 990, 0, 0), tick(1, 93000000, 1000, 1000, 1004), tick(1, 93030000, 1000, 1000, 1006), tick(1, 113000000, 1, 1, 1), tick(2, 93100000, 0, 0, 0), tick(2, 93200000, 5, 500, 0)]
    got = {(r.secu_code, r.minute): r for r in run(spark, SnapshotMinBar()(Source("orderbook")), orderbook=spark.createDataFrame(ticks, schema))}
    assert set(got) == {(c, m) for c in (1, 2) for m in (930, 931, 932)}
    r = got[1, 930]
    assert (r.AskPrice1, r.BidPrice1, r.AskPrice2, r.AskPrice9) == (pytest.approx(10.05), 10.0, pytest.approx(10.06), pytest.approx(10.06))
    size = lambda v, p: math.log(v * p + 1)
    assert r.aVOI1 == pytest.approx(size(100, 1000) - size(100, 1000) - size(100, 1006))
    assert got[1, 932].AskPrice1 == pytest.approx(10.05) and got[1, 932].aVOI1 == 0 and got[1, 932].AskVolume1 == 0
    assert got[2, 930].AskPrice1 is None and got[2, 932].AskPrice1 == 5.0 == got[2, 932].BidPrice1
    late = run(spark, SnapshotMinBar()(Source("orderbook")), orderbook=spark.createDataFrame([tick(3, 92500000, 700, 0, 0), tick(3, 93100000, 0, 0, 0)], schema))
    assert late[0].AskPrice1 == 700.0  # the pre-open price, in hundredths as it comes


def test_events_of_several_sessions_are_refused(spark):
    trades = spark.createDataFrame([("20200102", 1, 93000000, 1, 2, 1, 1000, 1.0, 0)], TRADES)
    engine = Engine(TableCatalog(spark, {"steptrades": trades, "steporders": spark.createDataFrame([], ORDERS)}, ["20200101", "20200102"]))
    node = TradesWithWaitBar()(Source("steptrades", lookback_days=2), Source("steporders"))
    with pytest.raises(ValueError, match="lookback_days=1"):
        engine.frame(Model("m", None, {"value": node}), node, ["20200102"])
