"""The operators. Importing the package registers how each lowers to a DataFrame."""

from quantloom.operators.aggregate import Aggregate
from quantloom.operators.arithmetic import Col, Op
from quantloom.operators.bars import CancelsMinBar, QuotesMinBar, TradesWithWaitBar
from quantloom.operators.combine import Join, Project
from quantloom.operators.fill import FillNull
from quantloom.operators.filters import Flag, Side, Threshold, TopQuantile, Where
from quantloom.operators.grid import Grid
from quantloom.operators.snapshot import SnapshotMinBar
from quantloom.operators.source import Source

__all__ = [
    "Aggregate", "CancelsMinBar", "Col", "FillNull", "Flag", "Grid", "Join", "Op", "Project", "QuotesMinBar", "Side",
    "SnapshotMinBar", "Source", "Threshold", "TopQuantile", "TradesWithWaitBar", "Where",
]
