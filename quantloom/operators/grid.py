"""Alignment to the grid of universe x sessions x minute bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators.aggregate import AUCTIONS, minutes_of
from quantloom.plans.frame import EVAL, Field, Frame, join_keys, union_keys
from quantloom.plans.graph import BAR, DAY, Layer, Node
from quantloom.plans.lowering import Lowering, register_operator


class Grid(Layer):
    """Rows for every stock of the universe and every bar; the frequency is inferred if not given."""

    op = "grid"

    def __init__(self, frequency: str | None = None, *, auction: str | None = None, name: str | None = None) -> None:
        if frequency is not None and minutes_of(frequency) is None:
            raise ValueError("a grid has minute bars")
        if auction is not None and auction not in AUCTIONS:
            raise ValueError(f"auction is one of {AUCTIONS}")
        super().__init__(name=name, frequency=frequency, auction=auction)


def inferred_policy(frame: Frame) -> tuple[str, str]:
    """The last minute step of the fields' paths; any dropped or merged auction leaves the grid without."""
    found = set()
    for field in frame.fields.values():
        steps = [(f, a) for f, a in field.path if minutes_of(f) is not None]
        if steps:
            found.add((steps[-1][0], "keep" if all(a == "keep" for _, a in steps) else "drop"))
    if len(found) > 1:
        raise ValueError(f"the grid's frequency is not clear from {sorted(found)}; pass frequency=")
    return found.pop() if found else ("1m", "keep")


@register_operator("grid")
def _grid(node: Node, low: Lowering) -> Frame:
    if low.universe is None:
        raise ValueError("a grid needs the model's universe")
    frame = low.own(node.inputs["input"])
    frequency, auction = inferred_policy(frame) if None in (node.params.get("frequency"), node.params.get("auction")) else ("", "")
    frequency, auction = node.params.get("frequency", frequency), node.params.get("auction", auction)
    calendar, interval = low.engine.catalog.minutes, minutes_of(frequency)
    bars = calendar.minbars() if interval == 1 else [calendar.auctions[0], *dict.fromkeys(calendar.bucket_map(interval).values()), calendar.auctions[1]]
    bars = [b for b in bars if auction == "keep" or b not in calendar.auctions]
    if all(k in frame.keys for k in BAR):
        on = BAR
    elif all(k in frame.keys for k in DAY):
        on = DAY
    else:
        raise ValueError("a grid needs date and secu_code keys")
    join_keys(BAR, frame.keys, on, "left")
    keys = union_keys(BAR, frame.keys)
    values = [c for c in frame.columns if c not in frame.keys]
    if clash := [c for c in values if c in keys]:
        raise ValueError(f"value columns {clash} clash with the grid's keys")
    lookback = max((f.lookback for f in frame.fields.values()), default=1)
    # the universe as of the evaluation date, for all the sessions it sees; days and bars are calendars
    days = low.spark.createDataFrame([(e, d) for e, ds in low.windows(lookback).items() for d in ds], f"{EVAL} string, date string")
    stocks = low.engine.catalog.universe(low.universe, list(low.dates)).withColumnRenamed("date", EVAL)
    minutes = low.spark.createDataFrame([(b,) for b in bars], "minute long")
    cells = stocks.join(F.broadcast(days), EVAL).join(F.broadcast(minutes))
    if frame.own_day == lookback:  # a cell finds its day's row, whichever evaluation date it is of
        made = cells.join(frame.df.drop(EVAL), list(on), "left")
    else:
        made = cells.join(low.seen(frame).df, [EVAL, *on], "left")
    return Frame(made, keys, {k: frame.fields.get(k, Field()) for k in keys} | {c: frame.fields[c] for c in values})
