"""Shortcuts that expand to common plans: market metrics, late-day filters, registered transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from quantloom.operators.aggregate import Aggregate
from quantloom.operators.arithmetic import Col
from quantloom.operators.filters import Flag, Side, Threshold, Where
from quantloom.plans.graph import Model, Node, public_name

_TRADED = Col("price") * Col("volume")
#: metric → (column or expression, rows that count, aggregate)
_METRICS = {
    "volume": (Col("volume"), None, "sum"),
    "no": (Col("no"), None, "sum"),
    "amount": (_TRADED, None, "sum"),
    "buyamount": (_TRADED, Side("buy"), "sum"),
    "sellamount": (_TRADED, Side("sell"), "sum"),
    "open": (Col("price"), Flag("is_first"), "first"),
    "close": (Col("price"), Flag("is_last"), "last"),
    "high": (Col("price"), None, "max"),
    "low": (Col("price"), None, "min"),
}


@dataclass(frozen=True)
class Metric:
    """A minute metric of a price-bar source; call it with the source node."""

    name: str
    alias: str | None = None

    def __post_init__(self) -> None:
        if self.name not in (*_METRICS, "vwap", "preclose"):
            raise ValueError(f"unsupported metric {self.name!r}")
        public_name(self.alias or self.name)

    def __call__(self, source: Node) -> Node:
        out = self.alias or self.name
        if self.name == "vwap":
            return (Metric("amount")(source) / Metric("volume")(source)).alias(out)
        if self.name == "preclose":
            return Node("metric_reserved", {"metric": "preclose", "alias": out}, {"input": source})
        expression, rows, agg = _METRICS[self.name]
        kept = source if rows is None else Where(rows)(source)
        return Aggregate("1m", agg, value_col=out, alias=out)(expression.alias(out)(kept))


def metric(name: str, alias: str | None = None) -> Metric:
    return Metric(name, alias)


def last(minute: int) -> Where:
    """Bars from `minute` on."""
    if not isinstance(minute, int) or isinstance(minute, bool):
        raise TypeError("a minute is an integer such as 1430")
    return Where(Threshold("minute", ">=", minute))


_TRANSFORMS: dict[str, Callable[[Node, str | None], Node]] = {}


def register_transform(name: str, build: Callable[[Node, str | None], Node]) -> None:
    _TRANSFORMS[name] = build


def transform(name: str, alias: str | None = None) -> Callable[[Node], Node]:
    """A registered transform by name; none is built in."""
    if name not in _TRANSFORMS:
        raise ValueError(f"unsupported transform {name!r}")
    return lambda node: _TRANSFORMS[name](node, alias)


class FactorRecipe:
    """Base of classes that build a model."""

    def build(self) -> Model:
        raise NotImplementedError
