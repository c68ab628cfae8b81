"""SimHash near-duplicates through vantage-point trees, and near copies by word-shingle similarity.

Fingerprints within `radius` bits are looked up in several trees. The first level of a tree parts them by some
bits of a block (a vantage value at radius 0: a pair within `radius` bits agrees on at least one of
radius + 1 blocks, so no linked pair is lost and none visits two shards of a tree); so many bits that a shard
expects SHARD unrelated rows. From there vantage points split by Hamming distance, with visitors
across the boundaries (module `vantage`); shards that are too large for one task are first split by distance
bands as DataFrames, in the same manner.

The first level is there because vantage points over all 64 bits prune little among unrelated
fingerprints, whose distances are 32 +- 4: at radius 4 a third of a shard lies just beyond its median boundary.

Equal fingerprints are one node from the start.

Near copies by similarity go through the same trees first: links between their SimHashes are verified by the shingle
sets and join what they can. An exact search among the shingles follows for the links that `radius` bits do not reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import vantage
from quantloom.llm.common import UPPER, arrow_rows, join_groups, materialise, partitions, table
from quantloom.llm.components import components

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: Rows of unrelated fingerprints that a shard expects, and rows from which a shard is split over tasks.
SHARD, HOT = 512, 200_000


# --- fingerprints -------------------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included unless `distinct`."""
    found = (text or "").encode("utf-8").translate(_LOWER).split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = memoryview(b" ".join(found)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    made = [digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]
    hashes = np.fromiter(made, np.uint64, n)
    return np.unique(hashes) if distinct else hashes


def majority_bits(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """A 64-bit number: a bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        octets = hashes[at : at + block].astype(">u8").view(np.uint8).reshape(-1, 8)
        for k in range(0, len(octets), 128):  # sums of at most 128 bits fit a byte
            counts += np.unpackbits(octets[k : k + 128], axis=1).sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """docs (doc_id, text) → (doc_id, fp): the fingerprint's 64 bits as a long; zero without words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([majority_bits(shingle_hashes(t.as_py(), words)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return arrow_rows(docs.select("doc_id", "text"), rows, "doc_id long, fp long")


# --- links within a shard -----------------------------------------------------------------------


def keyed(batches: Iterator[pa.RecordBatch], enough: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first, in parts of about `enough` rows that end with a key."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append([c.to_numpy() for c in b.columns])
        if sum(len(x[0]) for x in held) < enough or held[0][0][0] == held[-1][0][-1]:
            continue
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on in the next batch
        yield [x[:cut] for x in columns]
        held = [[x[cut:] for x in columns]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def forest_links(rows: DataFrame, radius: int, parts: int | None = None) -> DataFrame:
    """(key, fp) → (u, v) links between fingerprints, a spanning forest for each key's shard."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, signed in keyed(batches):
            fps = signed.view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            edges = []
            for a, n in zip(starts[sizes > vantage.LEAF].tolist(), sizes[sizes > vantage.LEAF].tolist(), strict=True):
                edges += [(a + x, a + y) for x, y in vantage.links(fps[a : a + n], radius)]
            small = np.flatnonzero(np.repeat((sizes <= vantage.LEAF) & (sizes > 1), sizes))
            edges += [(small[a], small[b]) for a, b in vantage.leaf_links(keys[small], fps[small], radius)]
            at = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(signed[at[:, 0]]), pa.array(signed[at[:, 1]])], ["u", "v"])

    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_rows(rows.repartition(parts, "key").sortWithinPartitions("key", "fp").select("key", "fp"), links, "u long, v long").distinct()


def split_hot(rows: DataFrame, radius: int, hot: int = HOT, rounds: int = 2) -> DataFrame:
    """Split shards of (key, fp) of over `hot` rows by Hamming distance to a vantage point, the shard's smallest
    fingerprint. A band is four radii wide; rows in the last radius of a band also go to the next,
    so any pair within the radius shares a band. What is still as large is dealt out in blocks."""
    for k in range(rounds):
        big = rows.groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("__n"), F.min("fp").alias("__v")).where(F.col("__n") > hot)
        # at most one row for each `hot` rows
        joined = rows.join(big, F.col("key") == F.col("__key"), "left")
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("__v")))
        band, into = F.floor(d / (4 * radius)), d % (4 * radius)
        bands = F.when(F.col("__n").isNull(), F.array(F.lit(0).cast("long"))).when(into >= 3 * radius, F.array(band, band + 1)).otherwise(F.array(band))
        rows = joined.select("key", "fp", F.explode(bands).alias("__band"), "__n").select(
            F.when(F.col("__n").isNull(), F.col("key")).otherwise(F.xxhash64("key", "__band", F.lit(k))).alias("key"), "fp"
        )
    sizes = rows.groupBy(F.col("key").alias("__key")).agg(F.ceil(F.count(F.lit(1)) / hot).alias("__blocks"))
    return in_blocks(rows, sizes, "fp")


def in_blocks(rows: DataFrame, blocks: DataFrame, by: str) -> DataFrame:
    """(key, `by`) with __blocks blocks for each __key → (key, `by`): every two blocks of a shard meet in a
    shard of their own, so any pair of its rows does. One block is the shard as it is."""
    mine = F.pmod(F.xxhash64(F.lit(6), by), "__blocks")
    dealt = rows.join(blocks, F.col("key") == F.col("__key")).select("key", by, mine.alias("__a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__b"))
    return dealt.select(F.xxhash64("key", F.least("__a", "__b"), F.greatest("__a", "__b")).alias("key"), by)


# --- 64-bit groups ------------------------------------------------------------------------------


def block_keys(fp: F.Column, radius: int, blocks: int | None = None, bits: int = 64) -> F.Column:
    """An array of tree keys for a 64-bit fingerprint (long): one for each choice of blocks - radius
    blocks out of `blocks`, so any pair within the radius agrees on one; of the chosen, the first `bits` bits
    count. More blocks make more trees with smaller shards, for larger tables."""
    blocks = blocks or radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for tree, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(1 << x for x in [x for k in chosen for x in range(edges[k], edges[k + 1])][:bits])
        keys.append(F.xxhash64(F.lit(tree), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))))
    return F.array(*keys)


def blocks_for(distinct_fps: int, radius: int, shard: int = SHARD) -> tuple[int, int]:
    """Blocks and bits such that a shard expects about `shard` unrelated fingerprints."""
    blocks, bits = radius + 1, max(1, int(np.ceil(np.log2(max(1, distinct_fps / shard)))))
    while blocks < 3 * radius and bits > 64 * (blocks - radius) // blocks:
        blocks += 1
    return blocks, bits


def tree_links(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (fp), distinct and read from files → (u, v) links between fingerprints that join all within `radius`
    bits, found by vantage-point trees."""
    blocks, bits = blocks_for(nodes.count(), radius)
    keys = nodes.select(F.explode(block_keys(F.col("fp"), radius, blocks, bits)).alias("key"), "fp")
    return forest_links(split_hot(keys, radius), radius, parts=partitions(nodes, 2 * comb(blocks, radius)))


def near_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """docs (doc_id, text) → (doc_id, fp, component): fingerprints within `radius` bits link, and
    component is the smallest doc_id reachable.

    Defined results: a text without words (null, empty, blank) has fingerprint zero and links like
    any other; repeated rows are kept; a null doc_id is no member of its component's minimum
    (the component is null if nothing else is in it); an empty table gives an empty result; other columns
    are ignored.
    """
    fps = materialise(fingerprints(docs, words), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    linked = components(tree_links(nodes, radius))
    grouped = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "low", "n", "component")
    lows = grouped.where(F.col("component").isNotNull()).groupBy(F.col("component").alias("__c")).agg(F.min("low").alias("__low"))
    # only fingerprints that are shared or linked are looked up; the others' component is their own document
    known = grouped.where((F.col("n") > 1) | F.col("component").isNotNull()).join(lows, F.col("component") == F.col("__c"), "left")
    known = materialise(known.select("fp", "n", F.coalesce("__low", "low").alias("lowest")), "groups")
    return join_groups(fps, known, ["fp"]).select("doc_id", "fp", F.coalesce("lowest", "doc_id").alias("component"))


# --- near-duplicates by similarity ---------------------------------------------------------------
#
# The vantage-point trees over SimHashes come first. Their links, verified by the shingle sets, make groups, and nothing
# within a group is compared again. At a similarity of 0.8 two SimHashes differ in 3 to 13 bits, so the trees leave links over.
# For those the search that follows is exact. In any one order of all shingles, two sets with a Jaccard similarity of t or more
# share a shingle among the first n - ceil(t * n) + 1 of each, n its size. These prefixes are the
# keys; every pair that shares one is a candidate, and only bounds that no true pair fails drop one before
# the shingle sets are compared.

#: Bits in which SimHashes differ at most that the trees link.
RADIUS = 4
#: Words of 64 bits in a parity map.
LANES = 16
#: The order puts shingles last that this many sampled documents hold at least; it only keeps shards small.
SAMPLE, SAMPLE_SHARE, COMMON_DOCS, MAX_COMMON = 10_000, 0.02, 4, 100_000
#: Shards of up to PAIRED rows give pairs; larger ones get the shingle sets, in blocks of so many rows and shingles.
PAIRED, BLOCK_ROWS, BLOCK_SHINGLES = 64, 4096, 4_000_000
#: Up to so many ids (8 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Keeps rounding from dropping a pair of just the asked similarity.
EPS = 1e-6


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * LANES cells: whether an odd number of the hashes falls there. Two maps differ in
    at most as many bits as the sets differ in members."""
    cells = np.bincount((hashes % np.uint64(64 * LANES)).astype(np.int64), minlength=64 * LANES)
    return np.packbits((cells & 1).astype(np.uint8)).view("<u8").astype(np.uint64)


def may_differ(sizes: np.ndarray | F.Column, similarity: float) -> np.ndarray | F.Column:
    """Members in which two sets of that similarity or more, of `sizes` in all, differ at most."""
    return sizes * ((1 - similarity) / (1 + similarity)) + EPS


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many documents of a sample hold, rarest first: at most MAX_COMMON."""
    share = max(SAMPLE / max(1, docs.count()), SAMPLE_SHARE)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = [shingle_hashes(t.as_py(), words, distinct=True) for t in b.column(1).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    sampled = docs.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < int(min(1, share) * (1 << 20)))
    counts = arrow_rows(sampled.select("doc_id", "text"), rows, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= COMMON_DOCS).orderBy(F.desc("n"), "shingle").limit(MAX_COMMON).collect()
    return np.array([r.shingle for r in reversed(found)], np.int64).view(np.uint64)


def shingle_nodes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, size, f1, f2, simhash, fp, prefix): the size of the set of shingles, its 128-bit name, its SimHash,
    its parity map and its prefix."""
    common = common_shingles(docs, words)
    by_name = np.argsort(common)
    sent = docs.sparkSession.sparkContext.broadcast((common[by_name], by_name))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ranks = sent.value

        def prefix(h: np.ndarray) -> bytes:
            n = len(h) - int(np.ceil(similarity * len(h) - EPS)) + 1 if len(h) else 0
            if len(names):
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                late = names[at] == h
                h = np.concatenate([h[~late], h[late][np.argsort(ranks[at[late]])]])
            return h[:n].tobytes()

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                made = [shingle_hashes(t.as_py(), words, distinct=True) for t in part.column(1)]
                named = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in made), "<i8").reshape(-1, 2)
                columns = [pa.array([len(h) for h in made], pa.int64()), pa.array(named[:, 0].copy()), pa.array(named[:, 1].copy())]
                columns.append(pa.array(np.array([majority_bits(h) for h in made], np.uint64).view(np.int64)))
                columns += [pa.array([parity_map(h).astype(">u8").tobytes() for h in made], pa.binary()), pa.array([prefix(h) for h in made], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "size", "f1", "f2", "simhash", "fp", "prefix"])

    return arrow_rows(docs.select("doc_id", "text"), rows, "doc_id long, size long, f1 long, f2 long, simhash long, fp binary, prefix binary")


def simhash_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes (id, simhash) → (u, v) pairs of ids: the links of the vantage-point trees between SimHashes, each of
    which stands for its smallest id, and of that id with the others of the same SimHash."""
    lows = materialise(nodes.groupBy(F.col("simhash").alias("fp")).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "simhashes")
    of = lambda side: lows.select(F.col("fp").alias(f"__{side}"), F.col("low").alias(f"low_{side}"))
    links = tree_links(lows, radius).join(of("u"), F.col("u") == F.col("__u")).join(of("v"), F.col("v") == F.col("__v"))
    same = join_groups(nodes.select("id", F.col("simhash").alias("fp")), lows.where("n > 1"), ["fp"]).where("low <> id")
    return links.select(F.col("low_u").alias("u"), F.col("low_v").alias("v")).union(same.select("low", "id"))


def prefix_rows(nodes: DataFrame) -> DataFrame:
    """(id, size, prefix) → (key, id, pos, size): a row for each shingle of the prefix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                keys = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
                again = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                pos = np.concatenate([np.arange(len(k)) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column(0).take(again), pa.array(pos), part.column(1).take(again)], ["key", "id", "pos", "size"])

    return arrow_rows(nodes.select("id", "size", "prefix"), rows, "key long, id long, pos long, size long")


def shard_pairs(rows: DataFrame, similarity: float, parts: int) -> DataFrame:
    """(key, id, pos, size) of shards of up to PAIRED rows → (u, v) pairs of ids. The shard of the first
    shingle that a true pair shares keeps it: what is left of both sets from there on is long enough."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(keys: np.ndarray, ids: np.ndarray, pos: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            for shift in range(1, len(keys)):
                at = np.flatnonzero(keys[:-shift] == keys[shift:])
                if not len(at):
                    break
                to = at + shift
                left = np.minimum(size[at] - pos[at], size[to] - pos[to])
                sizes = size[at] + size[to]
                ok = sizes - 2 * left <= may_differ(sizes, similarity)
                at, to = at[ok], to[ok]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[to])], ["u", "v"])

        for columns in keyed(batches):
            yield from settle(*columns)

    return arrow_rows(rows.repartition(parts, "key").sortWithinPartitions("key", "id").select("key", "id", "pos", "size"), pairs, "u long, v long").distinct()


def similar_forest(sets: list[np.ndarray], similarity: float, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sorted sets with that similarity or more, breadth-first: a
    member is compared with all that are not yet reached, and every link is verified. Members of one of `groups`
    are joined already: with one of them all are reached, by one link."""
    groups = np.arange(len(sets)) if groups is None else groups
    sizes = np.array([len(s) for s in sets], np.int64)
    maps = np.stack([parity_map(s) for s in sets])
    left, edges = np.arange(len(sets)), []
    while len(left):
        mine = groups[left] == groups[left[0]]
        queue, left = left[mine].tolist(), left[~mine]
        while queue and len(left):
            k = queue.pop()
            both = sizes[left] + sizes[k]
            near = np.flatnonzero(np.abs(sizes[left] - sizes[k]) <= may_differ(both, similarity))
            near = near[np.bitwise_count(maps[left[near]] ^ maps[k]).sum(-1, dtype=np.int32) <= may_differ(both[near], similarity)]
            found = []
            for at in range(0, len(near), 256):
                some = near[at : at + 256]
                of = np.concatenate([sets[x] for x in left[some].tolist()])
                same = sets[k][np.minimum(np.searchsorted(sets[k], of), sizes[k] - 1)] == of
                shared = np.add.reduceat(same, np.concatenate([[0], np.cumsum(sizes[left[some]])[:-1]]), dtype=np.int64)
                found.append(some[shared >= similarity * (both[some] - shared)])
            if found and len(hit := np.concatenate(found)):
                names, one = np.unique(groups[left[hit]], return_index=True)
                edges += [(k, x) for x in left[hit[one]].tolist()]
                reached = np.isin(groups[left], names)
                queue += left[reached].tolist()
                left = left[~reached]
    return edges


def hub_rows(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, id, size) rows of hot shards (key, hub) → (key, id, size): shards of one hub, their smallest
    id, are one, so the shards of a dense group, which have nearly the same members, are few."""
    return rows.join(hot.select("key", "hub"), "key").select(F.col("hub").alias("key"), "id", "size").distinct()


def shard_blocks(rows: DataFrame) -> DataFrame:
    """(key, id, size) → (__key, __blocks): blocks of at most so many rows and shingles; two blocks' worth is one."""
    shards = rows.groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    return shards.select("__key", F.when((F.col("n") <= 2 * BLOCK_ROWS) & (F.col("shingles") <= 2 * BLOCK_SHINGLES), 1).otherwise(blocks).cast("long").alias("__blocks"))


def shard_forests(rows: DataFrame, similarity: float, parts: int) -> DataFrame:
    """(key, id, set, joined) → (u, v): verified links that, with those between ids of the same `joined`, are a
    spanning forest for each key's shard."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(ids: list[int], sets: list[np.ndarray], joined: list[int]) -> pa.RecordBatch:
            made = similar_forest(sets, similarity, np.array(joined, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in made], pa.int64()), pa.array([ids[b] for _, b in made], pa.int64())], ["u", "v"])

        key, ids, sets, joined = None, [], [], []
        for b in batches:
            for k, i, s, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if k != key and ids:
                    yield settle(ids, sets, joined)
                    ids, sets, joined = [], [], []
                key = k
                ids.append(i)
                sets.append(np.frombuffer(s.as_py(), np.uint64))
                joined.append(j)
        if ids:
            yield settle(ids, sets, joined)

    return arrow_rows(rows.repartition(parts, "key").sortWithinPartitions("key", "id").select("key", "id", "set", "joined"), links, "u long, v long").distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set) of the documents that ids (__id) names, a row each."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_hashes(t.as_py(), words, distinct=True).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["id", "set"])

    found = arrow_rows(docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left_semi"), sets, "id long, set binary")
    return materialise(found.groupBy("id").agg(F.min("set").alias("set")), "sets")


def exactly_similar(found: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) links between ids of found (id, set) whose sets have a Jaccard similarity of `similarity` or more."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: found.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}"))
    return arrow_rows(links.join(of("u"), "u").join(of("v"), "v").select("u", "v", "set_u", "set_v"), similar, "u long, v long")


def in_groups(rows: DataFrame, groups: DataFrame, by: str, name: str) -> DataFrame:
    """rows with the component of their id `by` in groups (node, component), or else that id itself, as `name`."""
    side = groups.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    found = rows.join(side, F.col(by) == F.col("__node"), "left")
    return found.select(*rows.columns, F.coalesce("__component", by).alias(name))


def similar_links(docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """nodes (id, size, simhash, fp, prefix) → (u, v): verified links that join all that a similarity of
    `similarity` or more joins. docs has the texts of the ids."""
    near = materialise(simhash_pairs(nodes), "near")
    rows = prefix_rows(nodes)
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where(F.col("n") > PAIRED)
    hot = materialise(hot, "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    rest = rows.join(hot, "key", "left_anti")
    pairs = shard_pairs(rest, similarity, partitions(nodes, 4))
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("fp").alias(f"{s}_fp"), F.col("size").alias(f"{s}_size"))
    word = lambda s, k: F.conv(F.hex(F.substring(f"{s}_fp", 8 * k + 1, 8)), 16, -10).cast("long")
    differ = [F.bit_count(word("u", k).bitwiseXOR(word("v", k))) for k in range(LANES)]
    both = F.col("u_size") + F.col("v_size")
    pairs = materialise(pairs.join(side("u"), "u").join(side("v"), "v").where(sum(differ[1:], differ[0]) <= may_differ(both, similarity)).select("u", "v"), "pairs")
    hubs = materialise(hub_rows(rows, hot), "hubs")
    dealt = materialise(in_blocks(hubs, shard_blocks(hubs), "id"), "blocks")
    asked = near.union(pairs)
    sets = shingle_sets(docs, asked.select(F.col("u").alias("__id")).union(asked.select("v")).union(dealt.select("id")).distinct(), words)
    found = materialise(exactly_similar(sets, near, similarity), "near-links")
    groups = materialise(components(found), "near-groups")
    apart = in_groups(in_groups(pairs, groups, "u", "__u"), groups, "v", "__v").where("__u <> __v").select("u", "v")
    dense = shard_forests(in_groups(dealt, groups, "id", "joined").join(sets, "id"), similarity, partitions(sets, 4))
    return found.union(exactly_similar(sets, apart, similarity)).union(dense)


def duplicate_ids(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id) of every document that has a smaller doc_id in its group of near copies."""
    docs = docs.where(F.col("doc_id").isNotNull())
    fps = materialise(shingle_nodes(docs, words, similarity), "shingles")
    nodes = materialise(fps.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.first("simhash").alias("simhash"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n")), "nodes")
    linked = components(similar_links(docs, nodes, words, similarity)).select("node", "component").where("node <> component")
    # a document goes if it is a later copy or its node is in an earlier one's component
    known = nodes.join(linked, F.col("id") == F.col("node"), "left").where((F.col("n") > 1) | F.col("component").isNotNull())
    known = materialise(known.select("f1", "f2", "n", F.coalesce("component", "id").alias("keeper")), "keepers")
    found = join_groups(fps.select("doc_id", "f1", "f2"), known, ["f1", "f2"])
    return found.where(F.col("doc_id") != F.col("keeper")).select("doc_id").distinct()


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group linked by a Jaccard similarity of word shingles of
    `similarity` or more, the smallest doc_id stays.

    Defined results: all texts without words are copies of each other; a null doc_id always
    stays; repeated rows of the doc_id that stays all stay; other columns are passed through.
    """
    gone = duplicate_ids(docs, words, similarity).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
