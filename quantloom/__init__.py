"""A factor-graph engine for market micro-data on Spark DataFrames."""

from quantloom.engine import Engine, TraceStep
from quantloom.operators import (
    Aggregate, CancelsMinBar, Col, FillNull, Flag, Grid, Join, Op, Project, QuotesMinBar, Side, SnapshotMinBar, Source,
    Threshold, TopQuantile, TradesWithWaitBar, Where,
)
from quantloom.plans.graph import Layer, Model, Node
from quantloom.plans.lowering import register_operator
from quantloom.recipes import FactorRecipe, last, metric, register_transform, transform
from quantloom.sources.catalog import Catalog, ParquetCatalog, TableCatalog
from quantloom.sources.market import MinuteCalendar, TradingCalendar

__all__ = [
    "Aggregate", "CancelsMinBar", "Catalog", "Col", "Engine", "FactorRecipe", "FillNull", "Flag", "Grid", "Join", "Layer", "MinuteCalendar",
    "Model", "Node", "Op", "ParquetCatalog", "Project", "QuotesMinBar", "Side", "SnapshotMinBar", "Source", "TableCatalog", "Threshold",
    "TopQuantile", "TraceStep", "TradesWithWaitBar", "TradingCalendar", "Where", "last", "metric", "register_operator", "register_transform", "transform",
]
