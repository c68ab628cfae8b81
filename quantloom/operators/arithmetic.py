"""Columns, row arithmetic, arithmetic between frames, and rolling statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.scalars import arithmetic
from quantloom.plans.frame import EVAL, Field, Frame, merged
from quantloom.plans.graph import BAR, DAY, Node, public_name
from quantloom.plans.lowering import Lowering, register_operator

ARITHMETIC = ("add", "sub", "mul", "div")
ROLLING = ("rolling_corr", "rolling_beta", "rolling_alpha")


# --- building -----------------------------------------------------------------------------------


class FieldExpr:
    """An expression over a frame's columns; calling it with a frame node adds its value as a column."""

    name: str
    alias_name: str | None

    def alias(self, name: str) -> FieldExpr:
        return replace(self, alias_name=public_name(name))  # type: ignore[type-var]

    def __add__(self, other: Any) -> OpExpr:
        return _expression("add", self, other)

    def __radd__(self, other: Any) -> OpExpr:
        return _expression("add", other, self)

    def __sub__(self, other: Any) -> OpExpr:
        return _expression("sub", self, other)

    def __rsub__(self, other: Any) -> OpExpr:
        return _expression("sub", other, self)

    def __mul__(self, other: Any) -> OpExpr:
        return _expression("mul", self, other)

    def __rmul__(self, other: Any) -> OpExpr:
        return _expression("mul", other, self)

    def __truediv__(self, other: Any) -> OpExpr:
        return _expression("div", self, other)

    def __rtruediv__(self, other: Any) -> OpExpr:
        return _expression("div", other, self)


@dataclass(frozen=True)
class Col(FieldExpr):
    """A column of the frame."""

    name: str
    alias_name: str | None = None

    def spec(self) -> dict:
        return {"col": self.name}

    def __call__(self, frame: Node) -> Node:
        return Node("column", {"column": self.name, "alias": public_name(self.alias_name or self.name)}, {"input": frame})


@dataclass(frozen=True)
class OpExpr(FieldExpr):
    """An arithmetic expression."""

    name: str
    operands: tuple
    alias_name: str | None = None

    def spec(self) -> dict:
        return {"op": self.name, "of": [x.spec() if isinstance(x, FieldExpr) else {"lit": x} for x in self.operands]}

    def __call__(self, frame: Node) -> Node:
        return Node("op", {"mode": "row", "name": self.name, "expr": self.spec(), "alias": public_name(self.alias_name or f"{self.name}_value")}, {"input": frame})


def _operand(x: Any) -> Any:
    if isinstance(x, (Node, FieldExpr, bool, int, float)):
        return x
    raise TypeError(f"{x!r} cannot be an operand")


def _expression(name: str, *operands: Any) -> OpExpr:
    if any(isinstance(x, Node) for x in operands):
        raise ValueError("frames and column expressions do not mix")
    return OpExpr(name, tuple(_operand(x) for x in operands))


def Op(name: str, *operands: Any, alias: str | None = None, **params: Any) -> Node | OpExpr:
    """An operator over columns (an expression) or over frames (a node)."""
    if name not in ARITHMETIC + ROLLING:
        raise ValueError(f"unsupported operator {name!r}")
    given = [_operand(x) for x in operands]
    frames = [x for x in given if isinstance(x, Node)]
    if name in ROLLING:
        window = params.get("window")
        if not isinstance(window, int) or isinstance(window, bool) or window < 1:
            raise ValueError(f"{name} needs a window, a positive integer")
        if len(given) != 2 or len(frames) != 2:
            raise ValueError(f"{name} needs exactly two frames")
    if frames and any(isinstance(x, FieldExpr) for x in given):
        raise ValueError("frames and column expressions do not mix")
    if not frames:
        return OpExpr(name, tuple(given), None if alias is None else public_name(alias))
    inputs, specs = {}, []
    for x in given:
        if isinstance(x, Node):
            specs.append({"input": f"operand{len(inputs)}"})
            inputs[f"operand{len(inputs)}"] = x
        else:
            specs.append({"lit": x})
    return Node("op", {"mode": "frame", "name": name, "operands": specs, "alias": public_name(alias or f"{name}_value"), **params}, inputs)


# --- lowering -----------------------------------------------------------------------------------


def _column_of(spec: dict, columns: tuple[str, ...]) -> Column:
    if "lit" in spec:
        return F.lit(spec["lit"])
    if "col" in spec:
        if spec["col"] not in columns:
            raise ValueError(f"column {spec['col']!r} is not in {list(columns)}")
        return F.col(spec["col"])
    return arithmetic(spec["op"], [_column_of(x, columns) for x in spec["of"]])


def _with_column(node: Node, frame: Frame) -> Frame:
    """The frame with the column that a column or row-arithmetic node adds."""
    alias = node.params["alias"]
    if node.op == "column":
        name = node.params["column"]
        if name not in frame.columns:
            raise ValueError(f"column {name!r} is not in {list(frame.columns)}")
        made, field = F.col(name), frame.fields[name].plain()
    else:
        made, field = _column_of(node.params["expr"], frame.columns), replace(frame.origin(), operator=node.params["name"])
    return Frame(frame.df.withColumn(alias, made), frame.keys, frame.fields | {alias: field}, frame.own_day)


@register_operator("column")
def _column(node: Node, low: Lowering) -> Frame:
    return _with_column(node, low.own(node.inputs["input"]))


@register_operator("rename")
def _rename(node: Node, low: Lowering) -> Frame:
    frame, alias = low.own(node.inputs["input"]), node.params["alias"]
    old = frame.value("rename")
    return Frame(frame.df.withColumnRenamed(old, alias), frame.keys, {alias if c == old else c: f for c, f in frame.fields.items()}, frame.own_day)


@register_operator("op")
def _op(node: Node, low: Lowering) -> Frame:
    if node.params["mode"] == "row":
        return _with_column(node, low.own(node.inputs["input"]))
    return _between(node, low)


def _between(node: Node, low: Lowering) -> Frame:
    """Arithmetic between frames: inner joins on the keys that all must share. Operands are kept as
    hidden components, so that an aggregation can be of the components instead of the result."""
    name, alias, specs = node.params["name"], node.params["alias"], node.params["operands"]
    parts = _fused(node, low) or _joined(node, low)
    frame, components, hidden = parts
    frames = {k: f for k, f in zip(node.inputs, components, strict=True)}
    operands = [F.lit(s["lit"]) if "lit" in s else F.col(frames[s["input"]]) for s in specs]
    out = replace(
        merged([frame.fields[c] for c in components]),
        operator=name, components=tuple(components), recompute=name in ARITHMETIC and len(components) == 2 == len(specs),
    )
    fields = {k: frame.fields[k] for k in frame.keys} | {alias: out} | {c: frame.fields[c] for c in (*components, *hidden)}
    if name in ROLLING:
        if frame.keys == DAY or node.params.get("cross_day"):  # windows across sessions
            frame = low.seen(frame)
        made = rolling(frame.df, frame.keys, name, *operands, alias=alias, window=node.params["window"], cross_day=node.params.get("cross_day", False))
    else:
        made = frame.df.withColumn(alias, arithmetic(name, operands))
    return Frame(made, frame.keys, fields, frame.own_day)


def _joined(node: Node, low: Lowering) -> tuple[Frame, list[str], list[str]]:
    alias, keys, df = node.params["alias"], None, None
    frames = low.owns(node.inputs.values())
    own_day = frames[0].own_day
    fields: dict[str, Field] = {}
    components, hidden = [], []
    for k, (role, frame) in enumerate(zip(node.inputs, frames, strict=True)):
        if keys is None:
            keys = frame.keys
            fields |= {c: frame.fields[c] for c in keys}
        elif frame.keys != keys:
            raise ValueError(f"operands must have the same identity keys, not {keys} and {frame.keys}")
        value, component = frame.value("an operator between frames"), f"__op_{alias}_{k}"
        renamed = {h: f"__{role}_{h.removeprefix('__')}" for h in frame.hidden}
        part = frame.df.select(EVAL, *keys, F.col(value).alias(component), *(F.col(a).alias(b) for a, b in renamed.items()))
        df = part if df is None else df.join(part.drop(EVAL), list(keys), "inner") if own_day else df.join(part, [EVAL, *keys], "inner")
        fields |= {component: frame.fields[value].plain()} | {b: frame.fields[a] for a, b in renamed.items()}
        components.append(component)
        hidden += renamed.values()
    return Frame(df, keys, fields, own_day), components, hidden


def _fused(node: Node, low: Lowering) -> tuple[Frame, list[str], list[str]] | None:
    """One aggregation for operands that are aggregations of the same rows to the same grain, in place
    of an aggregation each and joins. Null keys would not have joined, so their groups go."""
    from quantloom.operators.aggregate import aggregated

    if node.params["name"] not in ARITHMETIC or len(node.inputs) < 2:
        return None
    chains = [_chain(child) for child in node.inputs.values()]
    if None in chains or len({(root.id, step) for root, _, _, step in chains}) != 1:
        return None
    root, step = chains[0][0], chains[0][3]
    rows, components, aggs = low.own(root), [], {}
    df, fields = rows.df, {k: rows.fields[k] for k in rows.keys}
    for k, (_, between, agg, _) in enumerate(chains):
        part = rows
        for link in between:
            part = _with_column(link, part)
        column = agg.params["value_col"]
        if column not in part.columns or column in part.keys:
            return None
        component = f"__op_{node.params['alias']}_{k}"
        expression = _column_through(between, column, rows.columns)
        df, components = df.withColumn(component, expression), [*components, component]
        fields[component], aggs[component] = part.fields[column].plain(), agg.params["agg"]
    wide = aggregated(Frame(df, rows.keys, fields, rows.own_day), *step, agg=aggs, minutes=low.engine.catalog.minutes, columns=components)
    return Frame(wide.df.dropna(subset=list(wide.keys)), wide.keys, wide.fields, wide.own_day), components, []


def _chain(node: Node) -> tuple[Node, list[Node], Node, tuple[str, str]] | None:
    """(rows, column nodes on them in order, aggregate, (frequency, auction)) behind an operand."""
    if node.op == "project":
        node = node.inputs["input"]
    if node.op != "aggregate" or not node.params.get("value_col") or node.params.get("apply_to") == "components":
        return None
    agg, between, root = node, [], node.inputs["input"]
    while root.op == "column" or (root.op == "op" and root.params["mode"] == "row"):
        between.insert(0, root)
        root = root.inputs["input"]
    return root, between, agg, (agg.params["frequency"].strip().lower(), agg.params.get("auction", "keep"))


def _column_through(between: list[Node], column: str, columns: tuple[str, ...]) -> Column:
    """What a column is in terms of the rows that the nodes between add it to."""
    known = {c: F.col(c) for c in columns}

    def of(spec: dict) -> Column:
        return F.lit(spec["lit"]) if "lit" in spec else known[spec["col"]] if "col" in spec else arithmetic(spec["op"], [of(x) for x in spec["of"]])

    for link in between:
        known[link.params["alias"]] = known[link.params["column"]] if link.op == "column" else of(link.params["expr"])
    return known[column]


def rolling(df: DataFrame, keys: tuple[str, ...], name: str, y: Column, x: Column, *, alias: str, window: int, cross_day: bool) -> DataFrame:
    """Rolling correlation, slope or intercept from population moments over full windows of non-nulls."""
    if not isinstance(cross_day, bool):
        raise ValueError("cross_day is true or false")
    if keys not in (BAR, DAY):
        raise ValueError("rolling operators need minute or daily keys")
    group = ["secu_code"] if keys == DAY or cross_day else list(DAY)
    over = W.partitionBy(EVAL, *group).orderBy(*keys).rowsBetween(1 - window, 0)
    x, y = x.cast("double"), y.cast("double")
    mean = lambda c: F.when(F.count(c).over(over) == window, F.avg(c).over(over))
    df = df.withColumns({"__y": mean(y), "__x": mean(x), "__xy": mean(x * y), "__xx": mean(x * x), "__yy": mean(y * y)})
    cov, var_x, var_y = (F.col(a) - F.col(b) * F.col(c) for a, b, c in (("__xy", "__y", "__x"), ("__xx", "__x", "__x"), ("__yy", "__y", "__y")))
    slope = F.when(var_x > 0, cov / var_x)
    made = {
        "rolling_beta": slope,
        "rolling_alpha": F.col("__y") - slope * F.col("__x"),
        "rolling_corr": F.when((var_x > 0) & (var_y > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / (F.sqrt(var_x) * F.sqrt(var_y))))),
    }[name]
    return df.withColumn(alias, made)
