"""Row filters. Conditions are small values that a node can hold; they lower to Catalyst predicates."""

from __future__ import annotations

import operator
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.plans.frame import EVAL, Frame
from quantloom.plans.graph import Layer, Node
from quantloom.plans.lowering import Lowering, register_operator

_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "=": operator.eq, "!=": operator.ne, "<>": operator.ne}


@dataclass(frozen=True)
class Side:
    """Rows of one side of the market."""

    side: str

    def __post_init__(self) -> None:
        if self.side not in ("buy", "sell"):
            raise ValueError("a side is 'buy' or 'sell'")

    def keep(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("side") == (0 if self.side == "buy" else 1))


@dataclass(frozen=True)
class Flag:
    """Rows with a true flag; null is not true."""

    column: str

    def keep(self, df: DataFrame) -> DataFrame:
        return df.where(F.coalesce(F.col(self.column), F.lit(False)))


@dataclass(frozen=True)
class Threshold:
    """Rows whose column compares to a literal; null compares to nothing."""

    column: str
    op: str = ">"
    value: Any = 0

    def __post_init__(self) -> None:
        if self.op not in _COMPARE:
            raise ValueError(f"unsupported comparison {self.op!r}")

    def keep(self, df: DataFrame) -> DataFrame:
        return df.where(_COMPARE[self.op](F.col(self.column), F.lit(self.value)))


@dataclass(frozen=True)
class TopQuantile:
    """Rows at or above their group's q-quantile, which is the nearest of the group's values."""

    column: str
    q: float = 0.9
    over: tuple[str, ...] = ("date", "secu_code")

    def __post_init__(self) -> None:
        if not 0 <= self.q <= 1:
            raise ValueError("q is between 0 and 1")
        object.__setattr__(self, "over", tuple(self.over))

    def keep(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.column).isNotNull()).withColumn("__floor", nearest_quantile(self.column, self.q, (EVAL, *self.over))).where(F.col(self.column) >= F.col("__floor")).drop("__floor")


def nearest_quantile(column: str, q: float, over: tuple[str, ...]) -> Column:
    """The value at rank round((n - 1) q) of each group, halves up. Ranks need one sort and no list, so
    a large group spills instead of filling memory."""
    group = W.partitionBy(*over)
    rank = F.row_number().over(group.orderBy(column))
    at = F.round((F.count(column).over(group) - 1) * F.lit(float(q))) + 1
    return F.max(F.when(rank == at, F.col(column))).over(group)


_KINDS: dict[str, type] = {c.__name__.lower(): c for c in (Side, Flag, Threshold, TopQuantile)}


def register_filter(condition: type) -> type:
    """Class decorator: a dataclass of plain values with `column` and `keep(df)` becomes a condition for Where."""
    kind = condition.__name__.lower()
    if kind in _KINDS:
        raise ValueError(f"a condition {kind!r} is registered already")
    _KINDS[kind] = condition
    return condition


class Where(Layer):
    """Keep the rows for which a condition holds; chained layers are a conjunction."""

    op = "where"

    def __init__(self, condition: Side | Flag | Threshold | TopQuantile, *, name: str | None = None) -> None:
        kind = type(condition).__name__.lower()
        if _KINDS.get(kind) is not type(condition):
            raise TypeError(f"{condition!r} is not a condition")
        super().__init__(name=name, kind=kind, condition={k: list(v) if isinstance(v, tuple) else v for k, v in asdict(condition).items()})


@register_operator("where")
def _where(node: Node, low: Lowering) -> Frame:
    condition = _KINDS[node.params["kind"]](**node.params["condition"])
    by_day = isinstance(condition, (Side, Flag, Threshold)) or (isinstance(condition, TopQuantile) and "date" in condition.over)
    frame = (low.own if by_day else low.frame)(node.inputs["input"])  # a filter of the user's may look across days
    named = ["side"] if isinstance(condition, Side) else [condition.column, *getattr(condition, "over", ())]
    if lost := [c for c in named if c not in frame.columns]:
        raise ValueError(f"the filter's columns {lost} are not in {list(frame.columns)}")
    return Frame(condition.keep(frame.df), frame.keys, frame.fields, frame.own_day)
