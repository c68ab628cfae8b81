"""The engine: lowers models to DataFrames and collects daily factors, all dates in one plan."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import quantloom.operators  # noqa: F401  registers the operators
from quantloom.plans.frame import EVAL, Frame
from quantloom.plans.graph import DAY, Model, Node, display_names
from quantloom.plans.lowering import Lowering
from quantloom.profiling import NEVER_KEPT, PlanProfile, Profiler, profile_plan
from quantloom.sources.catalog import Catalog

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class TraceStep:
    index: int
    resolved_name: str
    node: Node
    frame: DataFrame


def _dates(dates: Sequence[str]) -> tuple[str, ...]:
    if isinstance(dates, str) or not dates:
        raise ValueError("pass at least one date, in a list")
    return tuple(dict.fromkeys(str(d).replace("-", "") for d in dates))


class Engine:
    """Evaluates models over a catalog of sources."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog, self.spark = catalog, catalog.spark
        self._profiler: Profiler | None = None
        self._kept: list[DataFrame] = []

    # --- results --------------------------------------------------------------------------------

    def collect(self, model: Model, dates: Sequence[str], *, ordered: bool = False) -> DataFrame:
        """(date, secu_code, factor_name, value) of a model's daily outputs, aligned to its universe. A row
        for each stock of the universe and output; sorted only on request, for that shuffles."""
        return self._factors([model], dates, "collect", frozenset(), ordered)

    def collect_many(
        self, models: Sequence[Model], dates: Sequence[str], *, min_cache_ref_count: int = 2, exclude_cache_ops: Iterable[str] = NEVER_KEPT, ordered: bool = False
    ) -> DataFrame:
        """The factors of several models at once. Nodes that enough outputs need are persisted (memory and
        disk), until the next call or `release`."""
        if not models:
            raise ValueError("collect_many needs a model")
        names = [m.name for m in models]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"model names must differ: {twice}")
        self.release()
        shared = self.profile_plan(models, min_cache_ref_count=min_cache_ref_count, exclude_cache_ops=exclude_cache_ops)
        return self._factors(list(models), dates, "collect_many", frozenset(n.node_id for n in shared.cache_candidates()), ordered)

    def _factors(self, models: list[Model], dates: Sequence[str], what: str, persist: frozenset[str], ordered: bool) -> DataFrame:
        if homeless := [m.name for m in models if m.universe is None]:
            raise ValueError(f"{what} needs a universe; {homeless} have none (see evaluate_outputs)")
        days, began, parts = self._sessions(dates), time.perf_counter(), []
        logger.info("%s.start models=%s dates=%s", what, [m.name for m in models], days)
        with self.span(what, model=",".join(m.name for m in models), dates=days):
            lowerings: dict[str, Lowering] = {}
            for m in models:
                low = lowerings.setdefault(m.universe, Lowering(self, m.universe, days, persist))
                stocks = self.catalog.universe(m.universe, list(days))
                for name, node in m.output.items():
                    frame = low.own(node)
                    if not frame.collectable:
                        logger.error("output %s of %s is not daily", name, m.name)
                        raise ValueError(f"output {name!r} of {m.name!r} must be daily with one public value; its keys are {frame.keys}, its values {frame.values}")
                    parts.append(self._factor(frame, m.factor_name(name), stocks, days, len(parts)))
            made = reduce(DataFrame.unionByName, parts)
            if ordered:
                made = made.orderBy("date", "__output", "secu_code")
        logger.info("%s.done elapsed=%.3fs", what, time.perf_counter() - began)
        return made.drop("__output")

    @staticmethod
    def _factor(frame: Frame, name: str, stocks: DataFrame, days: tuple[str, ...], number: int) -> DataFrame:
        rows = frame.df.where(F.col("date").isin(*days) if frame.own_day else F.col("date") == F.col(EVAL))
        value = rows.select(*DAY, F.col(frame.value()).cast("double").alias("value"))
        return stocks.join(value, list(DAY), "left").select(*DAY, F.lit(name).alias("factor_name"), "value", F.lit(number).alias("__output"))

    def evaluate(self, model: Model, node: Node, date: str) -> DataFrame:
        """One node's frame as of a date, at its own grain."""
        with self.span("evaluate", node=node, model=model.name, universe=model.universe, date=date):
            return self._lowering(model, [date]).frame(node).df.drop(EVAL)

    def evaluate_outputs(self, model: Model, date: str) -> dict[str, DataFrame]:
        """A model's outputs as of a date, at any grain, without universe alignment."""
        with self.span("evaluate_outputs", model=model.name, universe=model.universe, date=date):
            low = self._lowering(model, [date])
            return {name: low.frame(node).df.drop(EVAL) for name, node in model.output.items()}

    def trace(self, model: Model, date: str) -> list[TraceStep]:
        """Every frame of a model as of a date, inputs first. Reserved markers have no frame."""
        low, names = self._lowering(model, [date]), display_names(model.nodes())
        nodes = [n for n in model.nodes() if n.op != "metric_reserved"]
        return [TraceStep(k, names[n.id], n, low.frame(n).df.drop(EVAL)) for k, n in enumerate(nodes)]

    def frame(self, model: Model, node: Node, dates: Sequence[str]) -> Frame:
        """A node's frame over several dates, with its fields and the evaluation date."""
        return self._lowering(model, dates).frame(node)

    def _lowering(self, model: Model, dates: Sequence[str]) -> Lowering:
        return Lowering(self, model.universe, self._sessions(dates))

    def _sessions(self, dates: Sequence[str]) -> tuple[str, ...]:
        days = _dates(dates)
        for d in days:
            self.catalog.calendar.previous_sessions(d, 1)  # raises for a day without a session
        return days

    # --- sharing and profiling ------------------------------------------------------------------

    def keep(self, df: DataFrame, node: Node) -> DataFrame:
        self.note("batch_cache.materialize", node=node)
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._kept[-1]

    def release(self) -> None:
        """Give back what collect_many persisted."""
        while self._kept:
            self._kept.pop().unpersist()

    def profile_plan(self, models: Sequence[Model], *, min_cache_ref_count: int = 2, exclude_cache_ops: Iterable[str] = NEVER_KEPT) -> PlanProfile:
        return profile_plan(models, min_cache_ref_count=min_cache_ref_count, exclude_cache_ops=exclude_cache_ops)

    @contextmanager
    def profiler(self) -> Iterator[Profiler]:
        """Record events of the calls inside; may be nested."""
        outer, self._profiler = self._profiler, Profiler()
        try:
            yield self._profiler
        finally:
            self._profiler = outer

    def note(self, event: str, elapsed_ms: float | None = None, *, node: Node | None = None, **fields: Any) -> None:
        if self._profiler is not None:
            self._profiler.record(event, elapsed_ms, **({"node_id": node.id, "op": node.op} if node is not None else {}), **fields)

    @contextmanager
    def span(self, event: str, **fields: Any) -> Iterator[None]:
        began = time.perf_counter()
        self.note(f"{event}.start", **fields)
        try:
            yield
        except Exception as bad:
            self.note(f"{event}.error", (time.perf_counter() - began) * 1e3, error=str(bad), **fields)
            raise
        self.note(f"{event}.end", (time.perf_counter() - began) * 1e3, **fields)
