"""Joins that align frames by identity keys, and projection to public columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import functions as F

from quantloom.plans.frame import EVAL, Frame, join_keys, union_keys
from quantloom.plans.graph import BAR, DAY, Layer, Node, public_name
from quantloom.plans.lowering import Lowering, register_operator

#: A left join on whatever identity keys the accumulated left side and each input share.
SHARED = "identity_intersection"


class Join(Layer):
    """Align named inputs by identity keys; the inputs' names become their columns' names."""

    op = "join"

    def __init__(self, *, how: str = "full", on: str | tuple[str, ...] | list[str] | None = None, name: str | None = None) -> None:
        how = how.strip().lower()
        if how not in ("full", "left"):
            raise ValueError("a join is 'full' or 'left'")
        keys = on if on is None or on == SHARED else [on] if isinstance(on, str) else list(on)
        if keys is not None and not keys:
            raise ValueError("on names at least one column")
        super().__init__(name=name, how=None if how == "full" else how, on=keys)

    def __call__(self, inputs: Node | Mapping[str, Node]) -> Node:
        if isinstance(inputs, Mapping):
            for key in inputs:
                public_name(key, "an input's name")
        return super().__call__(inputs)


class Project(Layer):
    """Identity keys and public values; hidden columns and components end here."""

    op = "project"

    def __init__(self, *, name: str | None = None) -> None:
        super().__init__(name=name)


def output_names(role: str, frame: Frame) -> dict[str, str]:
    """New names of an input's columns: its own name for a single value, prefixed for several or hidden."""
    many = len(frame.values) > 1
    names = {v: f"{role}__{v}" if many else role for v in frame.values}
    if clash := [n for n in names.values() if n in BAR]:
        raise ValueError(f"an input cannot be named {clash[0]!r}")
    return names | {h: f"__{role}_{h.lstrip('_')}" for h in frame.hidden}


def joined(parts: dict[str, Frame], how: str, on: list[str] | str | None) -> Frame:
    """Fold the inputs from the left; their own_day is the same. Rows are not sorted: order is for the end of a plan."""
    daily = [f.keys == DAY for f in parts.values()]
    if how == "full" and any(daily) and not all(daily):
        raise ValueError("a full join cannot mix daily and finer inputs; choose an anchor with how='left'")
    keys, df, fields = None, None, {}
    first = next(iter(parts.values()))
    day = [] if first.own_day else [EVAL]
    for role, frame in parts.items():
        names = output_names(role, frame)
        if clash := [n for n in names.values() if n in fields]:
            raise ValueError(f"join output columns clash: {clash}")
        right = frame.df.select(*day, *frame.keys, *(F.col(a).alias(b) for a, b in names.items()))
        if df is None:
            df, keys = right, frame.keys
        else:
            chosen = None if on in (None, SHARED) else tuple(on)
            if how == "left" and on is None:
                chosen = first.keys
            step = join_keys(keys, frame.keys, chosen, how)
            if clash := [c for c in right.columns if c in df.columns and c not in (EVAL, *step)]:
                raise ValueError(f"a {how} join would have columns twice: {clash}")
            df, keys = df.join(right, [*day, *step], how), union_keys(keys, frame.keys)
        if clash := [n for n in names.values() if n in keys]:
            raise ValueError(f"join output columns clash with keys: {clash}")
        fields |= {k: frame.fields[k].plain() for k in frame.keys if k not in fields}
        fields |= {b: replace(frame.fields[a], components=tuple(names.get(c, c) for c in frame.fields[a].components)) for a, b in names.items()}
    if first.own_day:
        df = df.withColumn(EVAL, F.col("date"))
    return Frame(df, keys, {k: fields[k] for k in keys} | {c: f for c, f in fields.items() if c not in keys}, first.own_day)


@register_operator("join")
def _join(node: Node, low: Lowering) -> Frame:
    frames = dict(zip(node.inputs, low.owns(node.inputs.values()), strict=True))
    return joined(frames, node.params.get("how", "full"), node.params.get("on"))


@register_operator("project")
def _project(node: Node, low: Lowering) -> Frame:
    frame = low.own(node.inputs["input"])
    fields = {c: replace(frame.fields[c], components=(), recompute=False) for c in (*frame.keys, *frame.values)}
    return Frame(frame.df, frame.keys, fields, frame.own_day)
