"""Aggregation to minute bars, buckets of bars, or days."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.scalars import arithmetic
from quantloom.plans.frame import EVAL, Field, Frame
from quantloom.plans.graph import BAR, DAY, Node, public_name
from quantloom.plans.lowering import Lowering, register_operator
from quantloom.sources.catalog import needs_minute
from quantloom.sources.market import MinuteCalendar

AGGS = ("sum", "mean", "max", "min", "std", "median", "first", "last")
AUCTIONS = ("keep", "drop", "merge")


def minutes_of(frequency: str) -> int | None:
    """The bar length of a frequency in minutes; None for a day."""
    text = frequency.strip().lower()
    if text in ("1d", "daily"):
        return None
    if not text.endswith("m") or not text[:-1].isdigit():
        raise ValueError(f"a frequency looks like '1m', '5m', '1d' or 'daily', not {frequency!r}")
    if int(text[:-1]) < 1:
        raise ValueError("a frequency is at least 1 minute")
    return int(text[:-1])


def Aggregate(frequency: str, agg: str, *, apply_to: str = "field", value_col: str | None = None, alias: str | None = None, auction: str = "keep", name: str | None = None):
    """A layer that aggregates public values. apply_to='components' aggregates what an arithmetic value was
    made of and computes it anew; otherwise hidden columns end here."""
    if apply_to not in ("field", "components"):
        raise ValueError("apply_to is 'field' or 'components'")
    if auction not in AUCTIONS:
        raise ValueError(f"auction is one of {AUCTIONS}")
    if agg not in AGGS:
        raise ValueError(f"agg is one of {AGGS}")
    if alias is not None:
        public_name(alias)
    minutes_of(frequency)
    params = {"frequency": frequency, "agg": agg, "apply_to": apply_to, "value_col": value_col, "alias": alias, "auction": None if auction == "keep" else auction}
    params = {k: v for k, v in params.items() if v is not None}

    def build(frame: Node) -> Node:
        if not isinstance(frame, Node):
            raise TypeError("Aggregate takes a frame node")
        made = Node("aggregate", params, {"input": frame}, name if apply_to == "components" else None)
        return made if apply_to == "components" else Node("project", {}, {"input": made}, name)

    return build


def agg_column(df: DataFrame, column: str, agg: str, order: list[str]) -> Column:
    """One aggregate; nulls do not count. first and last are by `order`, ties by the value itself."""
    c = F.col(column)
    if agg in ("sum", "mean", "std", "median") and df.schema[column].dataType.simpleString() == "boolean":
        c = c.cast("long")
    if agg in ("first", "last"):
        by = ", ".join(f"`{x}`" for x in [*order, column])
        return F.expr(f"{'min_by' if agg == 'first' else 'max_by'}(`{column}`, struct({by})) FILTER (WHERE `{column}` IS NOT NULL)")
    return {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp, "median": F.median}[agg](c)


@dataclass(frozen=True)
class _Spec:
    source: str
    output: str
    field: Field
    parts: tuple[str, ...]  # component columns to aggregate in the value's place
    outs: tuple[str, ...]


def _specs(frame: Frame, keys: tuple[str, ...], apply_to: str, columns: list[str], alias: str | None) -> tuple[list[_Spec], list[str]]:
    if alias is not None and len(columns) != 1:
        raise ValueError("an alias needs exactly one value column")
    specs = []
    for c in columns:
        field, output = frame.fields[c], alias or c
        if output in {*frame.keys, *keys}:
            raise ValueError(f"output {output!r} is an identity column; give an alias")
        parts: tuple[str, ...] = ()
        if apply_to == "components":
            if field.operator == "fill_null":
                raise ValueError("components are gone after FillNull; use apply_to='field'")
            if field.recompute and field.components:
                parts = field.components
        specs.append(_Spec(c, output, field, parts, tuple(f"__op_{output}_{k}" for k in range(len(parts)))))
    taken = {p for s in specs for p in s.parts} | {o for s in specs for o in (s.output, *s.outs)}
    return specs, [h for h in frame.hidden if h not in taken and h not in columns]


def _grouped(frame: Frame, df: DataFrame, keys: tuple[str, ...], agg: str | dict[str, str], specs: list[_Spec], hidden: list[str], order: list[str], step: tuple[str, str] | None) -> Frame:
    exprs, again, fields = [], {}, {k: frame.fields.get(k, Field()).plain() for k in keys}
    of = lambda column: agg if isinstance(agg, str) else agg[column]
    for s in specs:
        field = replace(s.field.plain(), path=s.field.path + ((step,) if step else ()))
        if s.parts:
            exprs += [agg_column(df, p, of(p), order).alias(o) for p, o in zip(s.parts, s.outs, strict=True)]
            again[s.output] = arithmetic(s.field.operator, [F.col(o) for o in s.outs])
            field = replace(field, operator=s.field.operator, components=s.outs, recompute=True)
        else:
            exprs.append(agg_column(df, s.source, of(s.source), order).alias(s.output))
        fields[s.output] = field
        fields |= {o: frame.fields[p].plain() for p, o in zip(s.parts, s.outs, strict=True)}
    exprs += [agg_column(df, h, of(h), order).alias(h) for h in hidden]
    fields |= {h: frame.fields[h] for h in hidden}
    if frame.own_day:  # EVAL would only repeat the date in every shuffled row
        made = df.groupBy(*keys).agg(*exprs).withColumn(EVAL, F.col("date"))
    else:
        made = df.groupBy(EVAL, *keys).agg(*exprs)
    return Frame(made.withColumns(again), keys, fields, frame.own_day)


def aggregated(
    frame: Frame, frequency: str, auction: str, *, agg: str | dict[str, str], minutes: MinuteCalendar, apply_to: str = "field",
    value_col: str | None = None, alias: str | None = None, columns: list[str] | None = None,
) -> Frame:
    """The frame at a coarser grain. `columns` may name hidden columns to aggregate as values, and agg may
    then be a function for each."""
    if value_col is not None and value_col not in frame.columns:
        raise ValueError(f"value_col {value_col!r} is not in {list(frame.columns)}")
    chosen = columns or ([value_col] if value_col is not None else list(frame.values))
    if not chosen:
        raise ValueError("there is no public value column to aggregate")
    interval, df, step = minutes_of(frequency), frame.df, (frequency, auction)
    timed = "minute" in frame.columns
    if interval is not None:
        needs_minute(frame.columns, f"Aggregate({frequency!r})")
    if timed:
        df = df.withColumn("__order_minute", F.col("minute"))
        if auction == "drop":
            df = df.where(~F.col("minute").isin(*minutes.auctions))
        elif auction == "merge":
            target = F.col("minute")
            for bar, into in minutes.merge_targets(interval or 1).items():
                target = F.when(F.col("minute") == bar, F.lit(into).cast("long")).otherwise(target)
            df = df.withColumn("minute", target)
    rest = [k for k in frame.keys if k not in BAR]
    if interval is None:
        order = ["__order_minute"] if timed else []
        if timed and auction == "merge":  # auctions first meet their bar, then bars the day
            specs, hidden = _specs(frame, BAR, apply_to, chosen, alias)
            frame = _grouped(frame, df, BAR, agg, specs, hidden, order + rest, None)
            df, chosen, rest, order = frame.df, [s.output for s in specs], [], ["minute"]
        specs, hidden = _specs(frame, DAY, apply_to, chosen, alias)
        return _grouped(frame, df, DAY, agg, specs, hidden, order + rest, step)
    if interval > 1:
        buckets = minutes.bucket_map(interval) | {a: a for a in minutes.auctions}
        table = df.sparkSession.createDataFrame(list(buckets.items()), "minute long, __bucket long")
        df = df.join(F.broadcast(table), "minute").drop("minute").withColumnRenamed("__bucket", "minute")  # some 240 rows
    specs, hidden = _specs(frame, BAR, apply_to, chosen, alias)
    return _grouped(frame, df, BAR, agg, specs, hidden, ["__order_minute", *rest], step)


@register_operator("aggregate")
def _aggregate(node: Node, low: Lowering) -> Frame:
    p = node.params
    return aggregated(
        low.own(node.inputs["input"]), p["frequency"].strip().lower(), p.get("auction", "keep"), agg=p["agg"], minutes=low.engine.catalog.minutes,
        apply_to=p.get("apply_to", "field"), value_col=p.get("value_col"), alias=p.get("alias"),
    )
