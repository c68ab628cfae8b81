"""The pipeline against a plain version of every stage on the smallest corpus."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quantloom.llm import quality, registry, simhash, toxicity

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def plain(spark):
    """Documents after each stage as {doc_id: text}, and the pieces of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    after = []
    score = toxicity.train(docs, labels).scorer()
    kept = {i: r.text for i, r in rows.items() if score(r.text) < toxicity.THRESHOLD}
    after.append(kept)
    model = quality.train(docs.where(docs.doc_id.isin(list(kept))), labels)
    batch = pa.RecordBatch.from_pydict({"text": list(kept.values()), "lang": [rows[i].lang for i in kept], "source": [rows[i].source for i in kept]})
    good = model.score(*quality._views(batch))[2] >= quality.THRESHOLD
    kept = {i: t for (i, t), ok in zip(kept.items(), good, strict=True) if ok}
    after.append(kept)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANKS))
    first = {}
    for i in sorted(kept):
        for line in kept[i].split("\n"):
            first.setdefault(key(line), i)
    kept = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in kept.items()}
    after.append(kept)
    sets = {i: set(simhash.shingle_hashes(t, 5, True).tolist()) for i, t in kept.items()}
    root = {i: i for i in kept}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(kept)
    for a, i in enumerate(order):
        for j in order[:a]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    kept = {i: t for i, t in kept.items() if top(i) == i}
    after.append(kept)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = set()
    for i, t in kept.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        pieces |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    return after, pieces


def test_stages_match_the_plain_version(spark, plain, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}-{name}")
        docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in docs.collect()} == plain[0][k]
            assert docs.where("n_chars <> char_length(text)").count() == 0
    check_pieces(docs.collect(), plain[1])


def test_run_matches_the_plain_version(spark, plain):
    check_pieces(corpus_pipeline.run(spark, SF).collect(), plain[1])


def check_pieces(rows, pieces):
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == pieces and len(rows) == len(pieces)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= np.ceil(sum(r.length for r in rows) / 2048) * 1.05 + 1


def test_stages_take_empty_tables_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0)], docs.schema)
    for given in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, given, SF).collect()


def test_registry_names():
    names = list(registry.queries())
    numbered = [n for n in names if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in numbered] == list(range(1, 11)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names) and corpus_pipeline.ORACLE_SQL is None
