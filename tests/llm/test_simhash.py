"""SimHash groups against brute force, and near-copy removal against exact Jaccard similarity."""

import random
import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import simhash, vantage
from quantloom.llm.components import components


def slow_fingerprint(text, k=4):
    low = bytes(range(256)).replace(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(low))
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def slow_groups(items, linked):
    """items: (id, value); smallest id reachable over linked pairs."""
    root = {i: i for i, _ in items}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(items):
        for j, y in items[:a]:
            if linked(x, y):
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in root}


def texts(seed, n):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Ünï", "CAPS", "x y"]
    made = []
    for _ in range(n):
        if made and rnd.random() < 0.5:
            t = rnd.choice(made).split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2, 6])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            made.append(" ".join(t))
        else:
            made.append(" ".join(rnd.choices(words, k=rnd.choice([1, 3, 5, 40, 120]))))
    return made


def test_fingerprints_equal_the_definition():
    for t in [*texts(1, 40), None, "", " \t\x0b", "one", "a b c", "A\x1fB c\x85d e f", "long " * 70_000]:
        assert simhash.majority_bits(simhash.shingle_hashes(t, 4)) == slow_fingerprint(t)


def test_groups_match_brute_force(spark):
    docs = list(enumerate([*texts(2, 150), None, "", "  "]))
    got = {r.doc_id: r.component for r in simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component")).collect()}
    want = slow_groups([(i, slow_fingerprint(t)) for i, t in docs], lambda x, y: (x ^ y).bit_count() <= 4)
    assert got == want


def planted(seed, n):
    rnd = random.Random(seed)
    fps = [rnd.getrandbits(64) for _ in range(n // 3)]
    while len(fps) < n:
        x = rnd.choice(fps)
        for _ in range(rnd.randint(1, 6)):
            x ^= 1 << rnd.randrange(64)
        fps.append(x)
    return sorted(set(fps))


def test_vantage_links_keep_connectivity():
    fps = np.array(planted(3, 6000), np.uint64)
    want = slow_components(fps)
    for radius, leaf in ((4, 32), (4, 100), (4, 2)):
        assert connected(len(fps), vantage.links(fps, radius, leaf)) == want


def test_every_pair_meets_once_in_a_leaf_and_branches_are_pruned():
    fps = np.array(planted(5, 2000), np.uint64)
    tally, met, compared = vantage.Tally(), set(), 0
    homes = []
    for members, guests in vantage.leaves(fps, 4, tally=tally):
        homes += members.tolist()
        compared += len(members) * (len(members) - 1) // 2 + len(members) * len(guests)
        for i in members.tolist():
            met |= {(min(i, j), max(i, j)) for j in [*members.tolist(), *guests.tolist()] if i != j}
    pairs = {(i, j) for i in range(len(fps)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4)).tolist()}
    assert sorted(homes) == list(range(len(fps))) and pairs <= met
    assert tally.nodes >= 40 and tally.leaves == tally.nodes + 1
    # unrelated fingerprints lie 32 +- 4 apart: about a quarter of the visits are pruned, and two thirds of the pairs spared
    assert tally.pruned > tally.visits / 5 > 0 and compared < 0.4 * len(fps) ** 2 / 2


def test_two_clusters_are_split_without_visitors():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(0, 2**63, 2, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << np.arange(40, dtype=np.uint64)) for c in centres]))
    tally = vantage.Tally()
    assert connected(len(fps), vantage.links(fps, 4, tally=tally)) == slow_components(fps)
    assert (tally.nodes, tally.leaves, tally.visits, tally.pruned) == (1, 2, 0, 40)


def test_the_query_goes_through_vantage_points(spark, monkeypatch):
    """On the driver's table most shards are split by a vantage point."""
    tables = []
    keep = simhash.forest_links
    monkeypatch.setattr(simhash, "forest_links", lambda rows, *a, **k: tables.append(rows) or keep(rows, *a, **k))
    groups = simhash.near_groups(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    sizes = [r["count"] for r in tables[0].groupBy("key").count().collect()]
    assert sum(n for n in sizes if n > 2 * vantage.LEAF) > 0.9 * sum(sizes)
    shard = tables[0].groupBy("key").agg(F.collect_list("fp").alias("fps")).orderBy(F.size("fps").desc()).first().fps
    tally = vantage.Tally()
    vantage.links(np.array(shard, np.int64).view(np.uint64), 4, tally=tally)
    assert tally.nodes > 5 and tally.pruned > 0 and tally.visits > 0
    fps = groups.select("fp").distinct().collect()
    fps = np.array([r.fp for r in fps], np.int64).view(np.uint64)
    low = {r.fp: r.component for r in groups.groupBy("fp").agg(F.min("component").alias("component")).collect()}
    root = slow_components(fps)
    want = {}
    for f, r in zip(fps.view(np.int64).tolist(), root, strict=True):
        want.setdefault(r, set()).add(f)
    assert len({low[f] for f in low}) == len(want) and all(len({low[f] for f in fs}) == 1 for fs in want.values())


def slow_components(arr):
    edges = []
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4):
            edges.append((i, i + 1 + int(j)))
    return connected(len(arr), edges)


def connected(n, edges):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    return [top(x) for x in range(n)]


def test_forest_over_blocks_loses_no_link(spark):
    fps = planted(4, 3000)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    want = slow_components(np.array(fps, np.uint64))
    for blocks, bits, hot in ((5, 64, 200_000), (5, 2, 200_000), (7, 64, 200_000), (7, 5, 200_000), (5, 4, 50)):
        keys = spark.createDataFrame(signed, "fp long").select(F.explode(simhash.block_keys(F.col("fp"), 4, blocks, bits)).alias("key"), "fp")
        links = simhash.forest_links(simhash.split_hot(keys, 4, hot), 4).collect()
        at = {s: k for k, (s,) in enumerate(signed)}
        assert connected(len(fps), [(at[r.u], at[r.v]) for r in links]) == want


def test_keys_follow_the_table():
    assert simhash.blocks_for(100, 4) == (5, 1) and simhash.blocks_for(512 * 64, 4) == (5, 6)
    for n in (10**6, 10**8, 10**10):
        blocks, bits = simhash.blocks_for(n, 4)
        assert n / 2**bits <= simhash.SHARD and bits <= 64 * (blocks - 4) // blocks


def test_dense_group_stays_linear():
    rnd = random.Random(6)
    base = rnd.getrandbits(64)
    fps = np.array(sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}), np.uint64)
    assert len(vantage.links(fps, 4)) == len(fps) - 1
    base = np.random.default_rng(9).integers(0, 2**63, 1, dtype=np.uint64)
    many = np.unique(base ^ np.random.default_rng(8).integers(0, 2**15, 30_000, dtype=np.uint64))
    began = time.perf_counter()
    assert len(vantage.links(many, 4)) == len(many) - 1 and time.perf_counter() - began < 60


def test_components(spark):
    rnd = random.Random(7)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(rnd.randrange(5000, 5400), rnd.randrange(5000, 5400)) for _ in range(150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: k for k, x in enumerate(nodes)}
    want = connected(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    assert got == {x: nodes[want[at[x]]] for x in nodes}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_copies_by_similarity(spark):
    docs = list(enumerate(texts(8, 200)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'l' as lang", "9 as id")
    got = {r.doc_id for r in simhash.one_of_each(frame).collect()}
    sets = [(i, set(simhash.shingle_hashes(t, 5, True).tolist())) for i, t in docs]
    want = slow_groups(sets, lambda x, y: len(x & y) >= 0.8 * len(x | y))
    assert got == {i for i, c in want.items() if i == c}
    assert simhash.one_of_each(frame).columns == frame.columns


def test_odd_documents(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "a b c d e f")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.one_of_each(docs).collect()) == ["2", "2", "3", "None"]
    groups = simhash.near_groups(docs).collect()
    assert {r.component for r in groups if r.doc_id in (3, 4)} == {3} and {r.component for r in groups if r.doc_id in (2, 5)} == {2} and len(groups) == 6
    assert simhash.near_groups(docs.limit(0)).collect() == [] and simhash.one_of_each(docs.limit(0)).collect() == []


def edited(rnd, words, edits):
    out = list(words)
    for k in rnd.sample(range(5, len(out) - 5), edits):
        out[k] = f"e{rnd.randrange(10**9)}"
    return out


def exact_keepers(docs, similarity=0.8):
    sets = [(i, set(simhash.shingle_hashes(t, 5, True).tolist())) for i, t in docs]
    want = slow_groups(sets, lambda x, y: len(x & y) >= similarity * len(x | y))
    return {i for i, c in want.items() if i == c}


def test_a_copy_beside_a_group_just_under_the_similarity(spark):
    rnd, docs = random.Random(11), []
    for _ in range(8):  # eight templates of 400 words: 60 texts at 0.77, and two at 0.82 of each other and 0.797 of those
        base = [f"w{rnd.randrange(10**9)}" for _ in range(404)]
        docs += [" ".join(edited(rnd, base, k)) for k in [5] * 60 + [4] * 2]
    docs = list(enumerate(docs))
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == exact_keepers(docs)


def test_every_member_of_a_large_group_looks_for_neighbours(spark):
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(10**9)}" for _ in range(300)]
    group = [edited(rnd, base, 1) for _ in range(11_000)]
    beside = [edited(rnd, group[k], 6) for k in range(5, 11_000, 500)]  # 0.82 of one member, 0.76 of the others
    docs = list(enumerate(" ".join(x) for x in group + beside))
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string").repartition(16)).collect()}
    assert got == {0}


def test_blocks_of_a_shard_compare_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", 4)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)
    rnd, docs = random.Random(13), []
    for _ in range(3):
        base = [f"w{rnd.randrange(10**9)}" for _ in range(150)]
        docs += [" ".join(edited(rnd, base, rnd.choice([1, 2, 2, 3]))) for _ in range(60)]
    docs = list(enumerate(docs))
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == exact_keepers(docs)


def test_short_texts_of_just_the_similarity(spark):
    rnd, docs = random.Random(14), []
    for k in range(300):
        text = [f"w{rnd.randrange(10**9)}" for _ in range(8)]
        docs += [text, [*text, "more"] if k % 2 else ["more", *text]]  # 4 of 5 shingles
    docs = list(enumerate(" ".join(x) for x in docs))
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == set(range(0, 600, 2))


def test_near_copies_come_through_the_vantage_point_trees(spark, monkeypatch):
    """The trees over SimHashes alone drop most copies with one word edited and no text under the similarity; with
    the search that follows them the result is that of brute force."""
    rnd, docs = random.Random(15), []
    for _ in range(40):
        base = [f"w{rnd.randrange(10**9)}" for _ in range(400)]
        docs += [" ".join(edited(rnd, base, k)) for k in (0, 1, 1, 1, 4, 9)]
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want, searched = exact_keepers(docs), []
    keep = simhash.forest_links
    monkeypatch.setattr(simhash, "forest_links", lambda rows, *a, **k: searched.append(rows.count()) or keep(rows, *a, **k))
    assert {r.doc_id for r in simhash.one_of_each(frame).collect()} == want and len(searched) == 1 and searched[0] > 4 * len(docs)
    monkeypatch.setattr(simhash, "prefix_rows", lambda nodes: spark.createDataFrame([], "key long, id long, pos long, size long"))
    alone = {r.doc_id for r in simhash.one_of_each(frame).collect()}
    assert want <= alone and len(docs) - len(alone) > 0.5 * (len(docs) - len(want))


def test_a_forest_over_groups_that_are_joined_already():
    rnd = random.Random(16)
    bases = [[f"w{rnd.randrange(10**9)}" for _ in range(200)] for _ in range(4)]
    sets = [simhash.shingle_hashes(" ".join(edited(rnd, bases[k % 4], rnd.choice([1, 2, 3]))), 5, True) for k in range(120)]
    similar = [(i, j) for i in range(120) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    groups = np.arange(120)
    for i, j in rnd.sample(similar, 60):
        groups[groups == groups[i]] = groups[j]
    made = simhash.similar_forest(sets, 0.8, groups)
    chains = [(i, int(np.flatnonzero(groups == groups[i])[0])) for i in range(120)]
    assert connected(120, made + chains) == connected(120, similar)
    assert len(made) == len(set(groups.tolist())) - len(set(connected(120, similar)))
    assert {(max(x), min(x)) for x in made} <= set(similar)
