"""From nodes to frames: a registry of operators and a memo, so that equal structures lower once."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from quantloom.plans.frame import EVAL, Frame
from quantloom.plans.graph import Node

if TYPE_CHECKING:
    from quantloom.engine import Engine

_OPERATORS: dict[str, Callable[[Node, Lowering], Frame]] = {}


def register_operator(op: str) -> Callable:
    """Register `lower(node, lowering) -> Frame` for an op; user code may add operators of its own."""

    def put(lower: Callable[[Node, Lowering], Frame]) -> Callable[[Node, Lowering], Frame]:
        if op in _OPERATORS:
            raise ValueError(f"operator {op!r} is registered already")
        _OPERATORS[op] = lower
        return lower

    return put


def registered() -> tuple[str, ...]:
    return tuple(_OPERATORS)


@dataclass
class Lowering:
    """One lowering of a plan for a universe and a set of evaluation dates."""

    engine: Engine
    universe: str | None
    dates: tuple[str, ...]
    persist: frozenset[str] = frozenset()
    memo: dict[str, Frame] = field(default_factory=dict)
    copies: dict[str, Frame] = field(default_factory=dict)

    @property
    def spark(self):
        return self.engine.spark

    def frame(self, node: Node) -> Frame:
        """The node's rows, there once for each evaluation date that sees them."""
        made = self.own(node)
        if made.own_day > 1 and node.id not in self.copies:
            self.copies[node.id] = self.seen(made)
        return self.copies.get(node.id, made)

    def owns(self, nodes: Iterable[Node]) -> list[Frame]:
        """Frames to be combined by date: all with their copies still due, or else all with them made."""
        nodes = list(nodes)
        made = [self.own(n) for n in nodes]
        if len({f.own_day for f in made}) == 1 and all("date" in f.keys for f in made):
            return made
        return [replace(self.frame(n), own_day=0) for n in nodes]

    def own(self, node: Node) -> Frame:
        """The node's frame for an operator that stays within a session, which may pass own_day on."""
        if node.id in self.memo:
            self.engine.note("eval.cache_hit", node=node, universe=self.universe)
            return self.memo[node.id]
        if node.op not in _OPERATORS:
            raise ValueError(f"no operator is registered for {node.op!r}")
        with self.engine.span("eval", node=node, universe=self.universe):
            made = _OPERATORS[node.op](node, self)
        if node.id in self.persist:
            made = replace(made, df=self.engine.keep(made.df, node))
        self.memo[node.id] = made
        return made

    def seen(self, frame: Frame) -> Frame:
        """The frame with the copies that are due. Pairs of days are a few thousand at most, the product of
        two numbers of days, so they are broadcast."""
        if frame.own_day < 2:
            return frame
        pairs = [(d, e) for e, days in self.windows(frame.own_day).items() for d in days]
        table = self.spark.createDataFrame(pairs, f"date string, {EVAL} string")
        return replace(frame, df=frame.df.drop(EVAL).join(F.broadcast(table), "date"), own_day=0)

    def windows(self, lookback: int) -> dict[str, list[str]]:
        """The sessions that each evaluation date sees."""
        return {d: self.engine.catalog.calendar.previous_sessions(d, lookback) for d in self.dates}
