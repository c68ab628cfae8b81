"""What plans share, before they run, and what the engine did, while they did."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quantloom.plans.graph import Model, ordered

NEVER_KEPT = ("source",)


@dataclass(frozen=True)
class NodeProfile:
    node_id: str
    kind: str
    op: str
    params: dict
    ref_count: int
    models: tuple[str, ...]
    depth: int
    cache_candidate: bool
    cache_reason: str

    @property
    def is_shared(self) -> bool:
        return self.ref_count > 1


@dataclass(frozen=True)
class PlanProfile:
    nodes: tuple[NodeProfile, ...]

    def shared_nodes(self) -> list[NodeProfile]:
        return [n for n in self.nodes if n.is_shared]

    def cache_candidates(self) -> list[NodeProfile]:
        return [n for n in self.nodes if n.cache_candidate]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n.node_id, n.kind, n.op, json.dumps(n.params, sort_keys=True), n.ref_count, len(n.models), list(n.models), n.depth, n.is_shared, n.cache_candidate, n.cache_reason) for n in self.nodes]
        return spark.createDataFrame(
            rows,
            "node_id string, kind string, op string, params string, ref_count long, model_count long, models array<string>, "
            "depth long, is_shared boolean, cache_candidate boolean, cache_reason string",
        )


def profile_plan(models: Iterable[Model], *, min_cache_ref_count: int = 2, exclude_cache_ops: Iterable[str] = NEVER_KEPT) -> PlanProfile:
    """How many outputs need each node. Those that enough outputs need are candidates for keeping."""
    if min_cache_ref_count < 1:
        raise ValueError("min_cache_ref_count is at least 1")
    models, never = list(models), set(exclude_cache_ops)
    needs: dict[str, int] = {}
    users: dict[str, dict[str, None]] = {}
    for m in models:
        for out in m.output.values():
            for n in ordered([out]):
                needs[n.id] = needs.get(n.id, 0) + 1
                users.setdefault(n.id, {})[m.name] = None
    depth: dict[str, int] = {}
    made = []
    for n in ordered([out for m in models for out in m.output.values()]):
        depth[n.id] = 1 + max((depth[c.id] for c in n.inputs.values()), default=-1)
        if n.op in never:
            reason = "excluded operator"
        elif needs[n.id] < min_cache_ref_count:
            reason = "too few outputs need it"
        else:
            reason = f"{needs[n.id]} outputs need it"
        kept = n.op not in never and needs[n.id] >= min_cache_ref_count
        made.append(NodeProfile(n.id, n.kind, n.op, n.params, needs[n.id], tuple(users[n.id]), depth[n.id], kept, reason))
    return PlanProfile(tuple(made))


@dataclass
class Profiler:
    """Events of the engine's calls: X.start, X.end, X.error, and single notes."""

    began: float = field(default_factory=time.perf_counter)
    events: list[dict[str, Any]] = field(default_factory=list)

    def record(self, event: str, elapsed_ms: float | None = None, **fields: Any) -> None:
        self.events.append({"event": event, "at_ms": (time.perf_counter() - self.began) * 1e3, "elapsed_ms": elapsed_ms, **fields})

    def to_frame(self, spark: SparkSession) -> DataFrame:
        known = ("model", "universe", "date", "node_id", "op")
        rows = [(e["event"], e["at_ms"], e["elapsed_ms"], *(e.get(k) for k in known), json.dumps({k: v for k, v in e.items() if k not in (*known, "event", "at_ms", "elapsed_ms")}, default=str)) for e in self.events]
        return spark.createDataFrame(rows, "event string, at_ms double, elapsed_ms double, model string, universe string, date string, node_id string, op string, fields string")
