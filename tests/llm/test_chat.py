"""Snapshot collapse and rendering against brute force."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest

from quantloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def place(row):
    t, r, x = row
    said = (f"1{len(r.encode())}:{r}" if r is not None else "0") + (f"1{x}" if x is not None else "0")
    return t is not None, t or 0, hashlib.md5(said.encode()).hexdigest()


def brute(rows):
    talks = {}
    for c, t, r, x in rows:
        if c is not None:
            talks.setdefault(c, []).append((t, r, x))
    talks = {c: [(r, x) for _, r, x in sorted(v, key=place)] for c, v in talks.items()}
    kept = {}
    for c in sorted(talks):
        if talks[c] not in kept.values() and not any(len(o) > len(talks[c]) and o[: len(talks[c])] == talks[c] for o in talks.values()):
            kept[c] = talks[c]
    return {c: "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in v) for c, v in kept.items()}


def run(spark, rows, schema=SCHEMA):
    turns = spark.createDataFrame(rows, schema)
    return chat.render(turns, chat.maximal_conversations(turns)).collect()


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for c in range(150):
        start = rnd.choice([0, 1, 1000, 1020, 5000])
        said = [("user", rnd.choice("ab")), ("assistant", rnd.choice("ab")), ("user", rnd.choice(["a", None, ""])), (None, "z"), ("user", "q")]
        rows += [(c, start + k, r, x) for k, (r, x) in enumerate(said[: rnd.randint(1, 5)])]
    rnd.shuffle(rows)
    assert run_rows(spark, rows) == brute(rows)


def run_rows(spark, rows):
    got = run(spark, rows)
    assert len({r.conv_id for r in got}) == len(got)  # a row a conversation
    sizes = {c: sum(r[0] == c for r in rows) for c in {r.conv_id for r in got}}
    assert {r.conv_id: r.n_turns for r in got} == sizes
    return {r.conv_id: r.text for r in got}


LONG = [(1, k, "user", f"t{k}") for k in range(5000)] + [(2, k, "user", f"t{k}") for k in range(3000)] + [(3, k, "user", f"t{k}") for k in range(1, 10)]
CASES = {
    "block border": [(1, 1023, "user", "a"), (1, 1024, "assistant", "b")],
    "null turn": [(1, None, "user", "first"), (1, 0, "user", "then")],
    "very long": LONG,
    "one turn number": [(1, 7, "user", f"t{k}") for k in range(4000)] + [(2, 7, "user", f"t{k}") for k in range(20)],
    "all equal": [(1, None, None, "same")] * 3000 + [(2, None, None, "same")] * 2999 + [(3, 0, None, "same")] * 3000,
    "no ids": [(None, 0, "user", "x"), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 1, None, None), (5, 1, "", "")],
    "tied nulls": [(1, 0, r, x) for r in (None, "", "a", "user") for x in (None, "", "b", "1")],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_cases_equal_brute_force_and_sql(spark, case):
    rows = CASES[case]
    want = brute(rows)
    assert run_rows(spark, rows) == want
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"})  # noqa: F841
    assert {c: t for c, _, t in duckdb.sql(chat.SQL).fetchall()} == want


def test_a_conversation_is_spread_over_runs(spark):
    """Also with one turn number, no run holds it all; rows go on in order from run to run."""
    for rows in (CASES["one turn number"], CASES["all equal"], LONG):
        turns = spark.createDataFrame(rows, SCHEMA)
        made = []
        keep = chat.materialise
        chat.materialise = lambda df, what: made.append((what, keep(df, what))) or made[-1][1]
        try:
            chat.prefix_hashes(turns)
        finally:
            chat.materialise = keep
        runs = dict(made)["turn-runs"].where("conv_id = 1").groupBy("run").count().collect()
        assert len(runs) > 2 and max(r["count"] for r in runs) < sum(r["count"] for r in runs) / 2


def test_clashing_columns(spark):
    rows = [(1, None, "user", "first", "e", 1, 2), (1, 0, "user", "then", "e", 1, 2)]
    got = run(spark, rows, SCHEMA + ", block string, n_turns int, run int")
    assert [(r.conv_id, r.n_turns, r.text.index("first") < r.text.index("then")) for r in got] == [(1, 2, True)]


def test_many_copies_leave_one(spark):
    rows = [(c, k, "user", f"t{k}") for c in range(500) for k in range(3)]
    assert [r.conv_id for r in run(spark, rows)] == [0]


def test_main_path_is_native(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)
    plan = chat.render(turns, chat.maximal_conversations(turns))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
