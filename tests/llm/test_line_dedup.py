"""Line dedup against brute force, and its defined results for odd input."""

import random

from pyspark.sql import functions as F

from quantloom.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_chars=10):
    holders = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or key(x) not in holders or min(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.kept_text(docs, line_dedup.line_bitmaps(docs)).collect()
    return [(r.doc_id, r["__lines"], r["__dropped"], r["__kept"]) for r in got]


def order(rows):
    return sorted(rows, key=repr)


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    pool = [f"common line number {k} of many" for k in range(30)] + ["short", "", "  Common LINE number 3 of many\t", "É common line ÀÉ with accents", "\x85not stripped line"]
    rows = [(k, "\n".join(rnd.choice(pool) if rnd.random() < 0.7 else f"own line {k} {rnd.random()}" for _ in range(rnd.randint(1, 200)))) for k in range(80)]
    assert order(run(spark, rows)) == order(brute(rows))


def test_hot_line_spans_runs(spark):
    rows = [(k, f"the one line that everyone has\nbut this one is {k} only") for k in range(3000)]
    got = run(spark, rows)
    assert sum(r[2] for r in got) == 2999 and [r[2] for r in got if r[0] == 0] == [0]


def test_frequent_lines_take_the_other_way(spark, monkeypatch):
    rows = [(k, f"the one line that everyone has\nbut this one is {k} only\nshared by a hundred of them {k // 100}") for k in range(3000)]
    for sample, n in ((512, 0), (1, 31)):
        monkeypatch.setattr(line_dedup, "SAMPLE", sample)
        found = []
        monkeypatch.setattr(line_dedup, "frequent_lines", lambda h, f=line_dedup.frequent_lines, found=found: found.append(f(h)) or found[0])
        assert order(run(spark, rows)) == order(brute(rows))
        assert found[0].count() == n if sample == 1 else found[0].count() <= 31
        monkeypatch.undo()


def test_one_range_exchange_of_the_hashes(spark):
    """The firsts come from the range partitions as they are: no row is shuffled by its hash after that."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = line_dedup.dropped_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(h1") == 1
    below = plan[plan.index("Window") : plan.index("rangepartitioning(h1")]
    assert "Sort [h1" in below and "hashpartitioning" not in below
    assert "hashpartitioning(h1" not in plan.replace("hashpartitioning(h1", "", 1)  # the pre-aggregated minimum of frequent lines alone


def test_odd_input(spark):
    long = "\n".join(f"line {k} of a very long text" for k in range(20_000))
    rows = [(None, "this line is shared by two"), (1, None), (2, ""), (3, "this line is shared by two"), (4, "this line is shared by two"), (4, "this line is shared by two"), (5, long), (6, long)]
    got = run(spark, rows)
    assert order(got) == order(brute(rows))
    assert [r[2] for r in got if r[0] == 6] == [20_000]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a shared line here", "x", 18, "w"), (2, "a shared line here\nmine", None, 23, "w"), (3, None, "y", None, None)], "doc_id long, text string, lang string, n_chars long, words string")
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns
    assert (got[2].text, got[2].n_chars) == ("mine", 4) and got[1].n_chars == 18 and got[3].text is None


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    made = line_dedup.kept_text(docs, line_dedup.line_bitmaps(docs))
    assert "Python" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()


def test_ascii_lower_leaves_other_letters(spark):
    got = spark.createDataFrame([("ÀBÇ",), ("ABC",), (None,)], "t string").select(line_dedup.ascii_lower(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["ÀbÇ", "abc", None]
