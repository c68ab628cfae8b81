"""Nodes, models and the minute calendar, without Spark."""

import pytest

from quantloom import Aggregate, Col, Join, MinuteCalendar, Model, Node, Project, Source, metric
from quantloom.plans.frame import join_keys, union_keys
from quantloom.plans.graph import display_names, ordered

SRC = Source("trades_tbar")


def test_ids_follow_structure_not_names():
    assert Source("a").id == Source("a", name="x").id != Source("b").id
    assert Source("a", lookback_days=1).id == Source("a").id != Source("a", lookback_days=2).id
    assert (metric("volume")(SRC) / 2).id == (metric("volume")(Source("trades_tbar")) / 2).id != (metric("volume")(SRC) / 2.0).id
    assert Aggregate("1m", "sum", auction="keep")(SRC).id == Aggregate("1m", "sum")(SRC).id
    assert len({SRC, Source("trades_tbar")}) == 1
    with pytest.raises(TypeError):
        Node("x", {"p": object()})


def test_models_check_their_outputs():
    for bad in ({}, {"": SRC}, {"v": 1}):
        with pytest.raises((TypeError, ValueError)):
            Model("m", "u", bad)
    with pytest.raises(TypeError):
        Model("m", "u", SRC)
    with pytest.raises(TypeError):
        Model("m", "", {"v": SRC})
    with pytest.raises(ValueError, match="frame"):
        Model("m", "u", {"v": Node("x", kind="scalar")})
    assert Model("m", "u", {"value": SRC}).factor_name("value") == "m" and Model("m", "u", {"v": SRC}).factor_name("v") == "m__v"


def test_order_and_names():
    vwap = metric("vwap")(SRC)
    nodes = Model("m", "u", {"value": vwap}).nodes()
    at = {n.id: k for k, n in enumerate(nodes)}
    assert all(at[c.id] < at[n.id] for n in nodes for c in n.inputs.values()) and len(at) == len(nodes)
    named = ordered([Project(name="a")(SRC), Project()(Source("trades_tbar", name="src"))])
    assert {n.name for n in named} == {"a", "src"}
    with pytest.raises(ValueError, match="conflicting"):
        ordered([Project(name="a")(SRC), Project(name="b")(SRC)])
    with pytest.raises(ValueError, match="two nodes"):
        display_names([Project(name="a")(SRC), Col("price")(SRC), Node("x", name="a")])


def test_mermaid():
    text = Model("m", "u", {"value": Join()({"a": metric("volume")(SRC), "b": Col("price").alias("p")(SRC)})}).explain_mermaid()
    assert text.startswith("flowchart TD") and '-- "a" --> step' in text and "<br>join" in text and "trades_tbar" in text and '(["m"])' in text
    assert text.count("[\"<b>") == len(Model("m", "u", {"value": Join()({"a": metric("volume")(SRC), "b": Col("price").alias("p")(SRC)})}).nodes())
    quoted = Model("m", "u", {"value": Project(name='say "x" | <y>')(SRC)}).explain_mermaid()
    assert "say #34;x#34; #124; #60;y#62;" in quoted


def test_minutes():
    c = MinuteCalendar()
    assert len(c.minbars()) == 239 and c.minbars()[0] == 925 and c.minbars()[-1] == 1500
    assert c.bucket_map(5)[934] == 930 and c.bucket_map(5)[1300] == 1300 and c.bucket_map(7)[1300] == 1129
    assert c.merge_targets(1) == {925: 930, 1500: 1456} and c.merge_targets(15)[1500] == 1445
    with pytest.raises(ValueError):
        c.bucket_map(0)


def test_join_rules():
    bar, side = ("date", "secu_code", "minute"), ("date", "secu_code", "minute", "side")
    assert join_keys(bar, side, None, "full") == bar and union_keys(bar, side) == side
    for left, right, on in ((bar, ("x",), None), (bar, side, ("date",)), (bar, side, ("side",))):
        with pytest.raises(ValueError):
            join_keys(left, right, on, "left")


@pytest.mark.parametrize("bad", [lambda: Aggregate("5x", "sum"), lambda: Aggregate("0m", "sum"), lambda: Aggregate("1m", "mode"), lambda: Aggregate("1m", "sum", auction="x"), lambda: Aggregate("1m", "sum", apply_to="x"), lambda: Source(""), lambda: Source("a", lookback_days=0)])
def test_bad_layers(bad):
    with pytest.raises((ValueError, TypeError)):
        bad()


def test_conditions_can_be_registered(spark):
    from dataclasses import dataclass

    from quantloom import Where
    from quantloom.operators.filters import register_filter

    @register_filter
    @dataclass(frozen=True)
    class Even:
        column: str

        def keep(self, df):
            return df.where(f"{self.column} % 2 = 0")

    assert Where(Even("no"))(SRC).params["kind"] == "even"
    with pytest.raises(ValueError, match="registered"):
        register_filter(Even)

    @dataclass(frozen=True)
    class Odd:
        column: str

    with pytest.raises(TypeError):
        Where(Odd("no"))
