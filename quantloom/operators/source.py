"""Scans: a source's rows on the sessions that each evaluation date sees."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.plans.frame import EVAL, Field, Frame
from quantloom.plans.graph import Node
from quantloom.plans.lowering import Lowering, register_operator


def Source(source: str, *, lookback_days: int = 1, name: str | None = None) -> Node:
    """Rows of a source on the last `lookback_days` sessions up to the evaluation date."""
    if not isinstance(source, str) or not source:
        raise TypeError("a source is named by text")
    if not isinstance(lookback_days, int) or isinstance(lookback_days, bool) or lookback_days < 1:
        raise ValueError("lookback_days is a positive integer")
    return Node("source", {"source": source} | ({"lookback_days": lookback_days} if lookback_days > 1 else {}), name=name)


@register_operator("source")
def _source(node: Node, low: Lowering) -> Frame:
    name, lookback = node.params["source"], node.params.get("lookback_days", 1)
    dates = sorted({d for days in low.windows(lookback).values() for d in days})
    catalog = low.engine.catalog
    keys = catalog.identity_keys(name)
    field = Field(source=name, lookback=lookback)
    rows = catalog.scan(name, dates).withColumn(EVAL, F.col("date"))
    return Frame(rows, keys, {c: field for c in catalog.schema(name, dates)}, lookback)
