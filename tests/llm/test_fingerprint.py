"""IBLT fingerprints: likeness equals that of the paragraph sets, neighbours, odd input."""

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from quantloom.llm import fingerprint


def pieces(text):
    return {x.strip(" ") for x in re.findall(r"[^\n.]{1,100}\.*|\.+", text or "")}


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def some_texts(n, seed=1):
    rnd = random.Random(seed)
    pool = [f"Sentence {k} says something." for k in range(40)]
    return [rnd.choice([" ", "\n"]).join(rnd.choices(pool, k=rnd.randint(0, 60))) for _ in range(n)] + ["", "x", "é" * 350, "...", "a\n\nb"]


def test_likeness_of_pairs(spark):
    rnd = random.Random(2)
    made = some_texts(60)
    pairs = [(a, rnd.choice(made)) for a in made] + [(None, None), (None, "x"), (made[0], made[0])]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.expr(fingerprint.likeness_sql("a", "b")).alias("l")).collect()
    for r in got:
        assert abs(r.l - likeness(r.a, r.b)) < 1e-12


def test_long_texts_are_dealt(spark):
    a = "\n".join(f"line {k}" for k in range(4000))
    b = "\n".join(f"line {k}" for k in range(2000, 6000))
    got = spark.createDataFrame([(a, b)], "a string, b string").select(F.expr(fingerprint.likeness_sql("a", "b")).alias("l")).first()
    assert abs(got.l - 2000 / 6000) < 1e-12


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [("same text. here",), ("same text. here",), ("other",), (None,), ("",)]
    got = [r.f for r in spark.createDataFrame(rows, "t string").select(F.expr(fingerprint.fingerprint_sql("t")).alias("f")).collect()]
    assert got[0] == got[1] != got[2] and got[3] == got[4]


def test_query_matches_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    ids = rnd.sample(range(100_000), 60) + [10**12, -5, 10**12 + 3]
    docs = [(i, t) for i, t in zip(ids, some_texts(58, 4), strict=True)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as near", "2 as block").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op5_fingerprint(spark, str(tmp_path)).collect()}
    down = sorted(docs, reverse=True)
    for k, (i, x) in enumerate(down):
        y, n = down[(k + 1) % len(down)][1], len(x) // 3
        edited = x[: len(x) - n] + y[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - likeness(x, edited)) < 1e-12 and abs(r.near_next - likeness(x, y)) < 1e-12


def neighbours(rows):
    """(doc_id, text, next text) of each row, as a multiset."""
    signed = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63
    down = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    return sorted(((i, t, down[(k + 1) % len(down)][1]) for k, (i, t) in enumerate(down)), key=repr)


def test_sparse_and_crowded_ids(spark, monkeypatch):
    rnd = random.Random(9)
    sparse = [(rnd.randrange(-(2**63), 2**63), f"t{k}") for k in range(3000)] + [(2**63 - 1, "top"), (-(2**63), "low")]
    crowded = [(None, f"n{k}") for k in range(900)] + [(7, f"s{k}") for k in range(900)] + [(k, f"d{k}") for k in range(300)] + [(7, "equal")] * 500 + [(None, None)] * 500
    for rows, crowd in ((sparse, 2048), (crowded, 2048), (crowded, 100)):
        monkeypatch.setattr(fingerprint, "CROWD", crowd)
        got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert sorted(map(tuple, got), key=repr) == neighbours(rows)


def test_equal_and_null_ids_are_spread_over_tasks(spark, monkeypatch):
    tables = {}
    keep = fingerprint.materialise
    monkeypatch.setattr(fingerprint, "materialise", lambda df, what: tables.setdefault(what, keep(df, what)))
    rows = spark.range(100_000).selectExpr("if(id % 2 = 0, 5, null) as doc_id", "concat('t', id % 50000) as text")
    fingerprint.with_next(rows)
    sizes = [r["count"] for r in tables["crowded"].groupBy("ids", "part").count().collect()]
    assert sum(sizes) == 100_000 and len(sizes) >= 8 and max(sizes) < 25_000


def test_texts_are_shuffled_once(spark):
    plan = fingerprint.with_next(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(ids") == 2  # the two are one when it runs: equal but for names


def test_tables_that_never_peel_are_compared_as_sets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "SIZES", (1,))
    made = some_texts(40, 6)
    pairs = list(zip(made, made[1:], strict=False))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.expr(fingerprint.likeness_sql("a", "b")).alias("l")).collect()
    assert all(abs(r.l - likeness(r.a, r.b)) < 1e-12 for r in got)


def test_odd_tables(spark, tmp_path):
    def run(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return fingerprint.op5_fingerprint(spark, f"{tmp_path}/{name}").collect()

    assert run("empty", []) == []
    one = run("one", [(7, "abc def")])
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    rows = run("odd", [(None, None), (None, "x. y"), (1, "a"), (1, "a"), (2, None)])
    assert len(rows) == 5 and sorted(r.n_chars for r in rows) == [0, 0, 1, 1, 4]


def test_main_path_is_native(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = fingerprint.op5_fingerprint(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
