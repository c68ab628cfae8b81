"""Minute bars from trades and orders: trades with waiting times, quotes, and cancels.

Everything is grouped and joined per evaluation date and stock. Whether a bar has the first or the last
event of its minute is decided by comparing ordering structs, so no global numbering or sort is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.scalars import bar_minute, empty_zero_sum, session_wait
from quantloom.plans.frame import EVAL, Field, Frame
from quantloom.plans.graph import Node
from quantloom.plans.lowering import Lowering, register_operator

# Exchange code space, order type codes, and the day the closing auction joined the trades.
FIRST_SH_CODE = 600000
SH_ORDERS, SH_CANCELS = {0: 0, 10: 1}, {-1: 0, -11: 1}
SZ_PRICED, SZ_MARKET = {2: 0, 12: 1}, {1: 0, 11: 1, 3: 0, 13: 1}
SZ_CANCELS = {-1: 0, -11: 1}
CLOSING_AUCTION_SINCE = "20180820"
OPEN, CLOSED = 93_000_000, 145_710_000

KEYS = ("date", "secu_code", "minute", "price", "side")


class _Builder:
    """A layer over trades and orders."""

    op = ""

    def __init__(self, *, name: str | None = None) -> None:
        self.name = name

    def __call__(self, trades: Node, orders: Node) -> Node:
        return Node(self.op, {}, {"trades": trades, "orders": orders}, self.name)


class TradesWithWaitBar(_Builder):
    """Trades by minute, price and side, with the volume-weighted wait of the resting order."""

    op = "trades_with_wait_bar"


class QuotesMinBar(_Builder):
    """Orders by minute, price and side."""

    op = "quotes_min_bar"


class CancelsMinBar(_Builder):
    """Cancelled orders by minute, price and side, with the volume-weighted time they stood."""

    op = "cancels_min_bar"


def events_of(low: Lowering, node: Node) -> DataFrame:
    """Rows of events. Orders and deals are matched within a session, so a longer lookback has no meaning here."""
    frame = low.own(node)
    if frame.own_day != 1:
        raise ValueError("bars are made of the events of one session: their sources take lookback_days=1")
    return frame.df


def _mapped(column: str, codes: dict[int, int]) -> Column:
    return F.coalesce(*(F.when(F.col(column) == a, F.lit(b).cast("long")) for a, b in codes.items()))


def bar(events: DataFrame, order: list[str | Column], waits: bool) -> DataFrame:
    """events (EVAL, date, secu_code, at, price, side, volume[, wait]) → bars. `order` tells which
    event of a minute came first; it must tell apart the events of different prices and sides."""
    made = events.withColumn("minute", bar_minute(F.col("at"))).withColumn("__rank", F.struct(*order))
    weighted = F.sum("volume")
    aggs = [empty_zero_sum(F.col("volume")).alias("volume")]
    if waits:
        total = F.coalesce(weighted, F.lit(0.0))
        aggs.append(F.when(total == 0, F.lit(float("nan"))).otherwise(empty_zero_sum(F.col("volume") * F.col("wait")) / total).alias("vw_wait_time"))
    aggs += [F.min("__rank").alias("__first"), F.max("__rank").alias("__last"), F.count("volume").alias("no")]
    minute = W.partitionBy(EVAL, "date", "secu_code", "minute")
    grouped = made.groupBy(EVAL, *KEYS).agg(*aggs)
    return grouped.withColumns({"is_first": F.col("__first") == F.min("__first").over(minute), "is_last": F.col("__last") == F.max("__last").over(minute)})


def _frame(df: DataFrame, waits: bool) -> Frame:
    values = ["volume", *(["vw_wait_time"] if waits else []), "is_first", "is_last", "no"]
    return Frame(df, KEYS, {c: Field() for c in (*KEYS, *values)}, 1)


def _placed(orders: DataFrame) -> DataFrame:
    """When each order that is no cancel was placed; an order with several rows has several times."""
    return orders.where(~F.col("order_type").isin(-1, -11)).select(EVAL, "secu_code", "order_id", F.col("order_time").alias("__placed"))


@register_operator("trades_with_wait_bar")
def _trades(node: Node, low: Lowering) -> Frame:
    trades, orders = events_of(low, node.inputs["trades"]), events_of(low, node.inputs["orders"])
    deals = trades.where(F.col("side").isin(0, 1)).select(
        EVAL, "date", "secu_code", F.col("deal_time").alias("at"), "deal_id", (F.col("price") / 100).alias("price"), "side", F.col("volume").cast("double").alias("volume"),
        F.least("buy_id", "sell_id").alias("order_id"),
    )
    waited = deals.join(_placed(orders), [EVAL, "secu_code", "order_id"], "left").withColumn("wait", session_wait(F.col("at"), F.col("__placed")))
    return _frame(bar(waited, ["at", "deal_id", "price", "side"], True), True)


def _events(df: DataFrame, at: str, order_id: Column, side: Column, price: Column | None = None) -> DataFrame:
    return df.select(
        EVAL, "secu_code", "date", F.col(at).alias("at"), (F.col("price") / 100 if price is None else price).alias("price"), F.col("volume").cast("double").alias("volume"),
        order_id.alias("order_id"), side.alias("side"),
    )


def order_events(trades: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quote and cancel events. Orders are told apart by their type codes, trades by stock code."""
    has = lambda codes: F.col("order_type").isin(list(codes))
    oid = F.col("order_id")
    sh, sz = trades.where(F.col("secu_code") >= FIRST_SH_CODE), trades.where(F.col("secu_code") < FIRST_SH_CODE)

    sh_quotes = _events(orders.where(has(SH_ORDERS)), "order_time", oid, _mapped("order_type", SH_ORDERS))
    at = F.col("deal_time")
    taken = sh.where(F.when(F.col(EVAL) >= CLOSING_AUCTION_SINCE, at.between(OPEN, CLOSED)).otherwise(at >= OPEN))
    sh_taken = _events(taken, "deal_time", F.greatest("buy_id", "sell_id"), F.col("side"))
    sh_cancels = _events(orders.where(has(SH_CANCELS)), "order_time", oid, _mapped("order_type", SH_CANCELS))

    sz_priced = _events(orders.where(has(SZ_PRICED)), "order_time", oid, _mapped("order_type", SZ_PRICED))
    # the price of a market order is the best one that it was filled at, as buyer if it was one
    fills = sz.where(F.col("side").isin(0, 1))
    sides = [fills.groupBy(EVAL, "secu_code", F.col(f"{who}_id").alias("order_id")).agg(best("price").alias(f"__{who}")) for who, best in (("buy", F.max), ("sell", F.min))]
    market = orders.where(has(SZ_MARKET)).drop("price")
    for found in sides:
        market = market.join(found, [EVAL, "secu_code", "order_id"], "left")
    discovered = market.withColumn("price", F.coalesce("__buy", "__sell")).where(F.col("price").isNotNull())
    sz_market = _events(discovered, "order_time", oid, _mapped("order_type", SZ_MARKET))
    sz_quotes = sz_priced.unionByName(sz_market)
    known = sz_quotes.select(EVAL, "secu_code", "order_id", F.col("price").alias("__price"))
    gone = sz.where(F.col("side").isin(list(SZ_CANCELS))).withColumn("order_id", F.col("buy_id") + F.col("sell_id"))
    sz_cancels = _events(gone.join(known, [EVAL, "secu_code", "order_id"]).where(F.col("__price").isNotNull()), "deal_time", oid, _mapped("side", SZ_CANCELS), F.col("__price"))
    return sz_quotes.unionByName(sh_quotes).unionByName(sh_taken), sz_cancels.unionByName(sh_cancels)


#: What orders the events of a minute.
_ORDER = ["at", "order_id", "fill", "side"]


def _ranked(events: DataFrame) -> DataFrame:
    """Of an order's fills at one time, a buy's first is the lowest price, a sell's the highest."""
    return events.withColumn("fill", F.when(F.col("side") == 0, F.col("price")).otherwise(-F.col("price")))


@register_operator("quotes_min_bar")
def _quotes(node: Node, low: Lowering) -> Frame:
    quotes, _ = order_events(events_of(low, node.inputs["trades"]), events_of(low, node.inputs["orders"]))
    return _frame(bar(_ranked(quotes), _ORDER, False), False)


@register_operator("cancels_min_bar")
def _cancels(node: Node, low: Lowering) -> Frame:
    orders = events_of(low, node.inputs["orders"])
    _, cancels = order_events(events_of(low, node.inputs["trades"]), orders)
    stood = cancels.join(_placed(orders), [EVAL, "secu_code", "order_id"], "left").withColumn("wait", session_wait(F.col("at"), F.col("__placed")))
    return _frame(bar(_ranked(stood), _ORDER, True), True)
