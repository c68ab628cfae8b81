"""Minute bars of the order book: mean prices and volumes, and order-flow terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.bars import events_of
from quantloom.plans.frame import EVAL, Field, Frame
from quantloom.plans.graph import BAR, Layer, Node
from quantloom.plans.lowering import Lowering, register_operator
from quantloom.sources.contracts import COLUMNS, LEVELS

FLOW_LEVELS = range(1, 6)
OPEN, NOON, REOPEN, CLOSE = 93_000_000, 113_000_000, 130_000_000, 145_700_000
#: Averaged prices are in currency units; the pre-open price that fills empty books stays in
#: hundredths, as it is in the vendor's bars.
PRICE_UNIT = 100


class SnapshotMinBar(Layer):
    """Order-book ticks to a bar for each stock and each minute that any stock has."""

    op = "snapshot_min_bar"

    def __init__(self, *, name: str | None = None) -> None:
        super().__init__(name=name)


def filled_book(df: DataFrame) -> DataFrame:
    """Empty prices come from the other side at the top and from the level above below it; null volumes are 0."""
    empty = lambda side, k: F.nullif(F.col(f"{side}Price{k}").cast("double"), F.lit(0.0))
    new: dict[str, Column] = {}
    for side, other in (("Ask", "Bid"), ("Bid", "Ask")):
        top = F.coalesce(empty(side, 1), empty(other, 1))
        for k in LEVELS:
            new[f"{side}Price{k}"] = F.coalesce(*(empty(side, j) for j in range(k, 1, -1)), top)
            new[f"{side}Volume{k}"] = F.coalesce(F.col(f"{side}Volume{k}").cast("double"), F.lit(0.0))
    return df.withColumns(new)


def order_flow(df: DataFrame) -> DataFrame:
    """aVOI1..5 of each tick from the change to the stock's previous tick."""
    ticks = W.partitionBy(EVAL, "secu_code").orderBy("tick_time")
    new = {}
    for k in FLOW_LEVELS:
        terms = []
        for side, worse in (("Bid", lambda now, was: now <= was), ("Ask", lambda now, was: now >= was)):
            price = F.col(f"{side}Price{k}")
            size, was = F.log(F.col(f"{side}Volume{k}") * price + 1), F.lag(price).over(ticks)
            terms.append(worse(price, was).cast("int") * size - (price == was).cast("int") * F.lag(size).over(ticks))
        new[f"aVOI{k}"] = terms[0] - terms[1]
    return df.withColumns(new)


def snapshot_bars(ticks: DataFrame) -> DataFrame:
    at = F.col("tick_time")
    before = ticks.where((at <= OPEN) & F.col("price").isNotNull() & (F.col("price") != 0))
    fallback = before.groupBy(EVAL, "secu_code").agg(F.max_by("price", "tick_time").cast("double").alias("__aux"))
    live = ticks.where(at.between(0, NOON - 1) | at.between(REOPEN, CLOSE - 1))
    flow = order_flow(filled_book(live).where(at >= OPEN))
    sides = ("Ask", "Bid")
    means = [(F.avg(f"{s}Price{k}") / PRICE_UNIT).alias(f"{s}Price{k}") for s in sides for k in LEVELS]
    means += [F.avg(f"{s}Volume{k}").alias(f"{s}Volume{k}") for s in sides for k in LEVELS]
    sums = [F.coalesce(F.sum(f"aVOI{k}"), F.lit(0.0)).alias(f"aVOI{k}") for k in FLOW_LEVELS]
    bars = flow.groupBy(EVAL, "secu_code", F.floor(at / 100_000).cast("long").alias("minute")).agg(*means, *sums)
    # every observed stock at every observed minute of its day: at most 240 minutes a day
    cells = bars.select(EVAL, "secu_code").distinct().join(F.broadcast(bars.select(EVAL, "minute").distinct()), EVAL)
    whole = cells.join(bars, [EVAL, "secu_code", "minute"], "left").join(fallback, [EVAL, "secu_code"], "left")
    so_far = W.partitionBy(EVAL, "secu_code").orderBy("minute").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = whole.withColumns({f"{s}Price1": F.coalesce(F.last(f"{s}Price1", ignorenulls=True).over(so_far), "__aux") for s in sides})
    return filled_book(whole).withColumns({f"aVOI{k}": F.coalesce(f"aVOI{k}", F.lit(0.0)) for k in FLOW_LEVELS} | {"date": F.col(EVAL)})


@register_operator("snapshot_min_bar")
def _snapshot(node: Node, low: Lowering) -> Frame:
    values = [c for c in COLUMNS["snapshot_tbar"] if c not in BAR]
    return Frame(snapshot_bars(events_of(low, node.inputs["input"])), BAR, {c: Field() for c in (*BAR, *values)})
