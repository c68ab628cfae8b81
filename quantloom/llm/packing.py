"""Hierarchical best-fit packing of tokenized documents into fixed-length sequences.

Every partition packs its pieces by best fit, longest first; bins that are nearly full are done.
Underfull bins become items of the next round, in which fewer partitions best-fit them again
as wholes, until one partition has seen what is left or a round saves no bin. Each round is a
written table of moves (bin, bin it went to, offset) of the bins that were underfull at first; a piece's
place is that of its first bin, moved.

Tokens are those of the tokenizers library. The byte-level split is the same wherever a text is cut into
its pre-tokens, so texts of settled scripts are split by a regular expression, and the library's model is
asked once for each distinct short piece; any other text goes through the library whole.

Defined results: a null or empty text is the end token alone; null and repeated doc_ids keep
their pieces; strings of special tokens in a text become those tokens, as the library has it; an empty
table gives an empty result; other columns are ignored. A task holds at most `block` items of a few
numbers each, whatever the table's size.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.bpe import BYTE_NAMES
from quantloom.llm.common import BoundedTable, arrow_rows, kept_by_worker, materialise, table

CAPACITY = 2048
#: Bins with at most this room left are done.
SLACK = 8
BLOCK = 200_000
END_ID = 0
#: The split of a byte-level tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for a text of ASCII alone; alternatives that start with different characters, the most frequent first.
ASCII_SPLIT = r""" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Characters whose class is the same in every Unicode version in use: Latin to Cyrillic without unassigned
#: places, Arabic and Devanagari letters, punctuation, kana, common Han, Hangul.
SETTLED = r"[\x00-\u0377\u0391-\u03a1\u03a3-\u03ff\u0400-\u0527\u05d0-\u05ea\u0620-\u064a\u0660-\u0669\u0905-\u0939\u1e00-\u1eff\u2000-\u2027\u2030-\u205e\u20a0-\u20b5\u2190-\u23f3\u2500-\u26ff\u3000-\u303f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]*"


@lru_cache(maxsize=1)
def settled_split() -> re.Pattern[str]:
    """SPLIT for settled texts, with its classes spelt out as ranges, which `re` looks up faster than `regex`."""
    settled = regex.findall(SETTLED.removesuffix("*"), "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000)))))

    def ranges(kind: str) -> str:
        found: list[list[int]] = []
        for x in map(ord, regex.findall(kind, "".join(settled))):
            if found and found[-1][1] == x - 1:
                found[-1][1] = x
            else:
                found.append([x, x])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in found)

    letters, numbers, blanks = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    return re.compile(rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


@kept_by_worker
def byte_encoder(path: str, limit: int = 150_000) -> Callable[[str], np.ndarray]:
    """text → uint32 ids, by a tokenizers-library file of a byte-level BPE; memory is bounded by `limit` pieces."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    spec = json.load(open(path, encoding="utf-8"))
    split = spec["pre_tokenizer"]
    if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        raise ValueError(f"{path} is not a plain byte-level tokenizer")
    specials, merge = [t["content"] for t in spec["added_tokens"]], library.model.tokenize
    pieces, ascii_pieces, settled = settled_split().findall, re.compile(ASCII_SPLIT, re.ASCII).findall, regex.compile(SETTLED).fullmatch
    named = {b: BYTE_NAMES[b] for b in range(128)}

    def piece_ids(piece: str) -> bytes:
        ids = [t.id for t in merge(piece.translate(named) if piece.isascii() else "".join([BYTE_NAMES[b] for b in piece.encode()]))]
        return pack_ids(f"<{len(ids)}I", *ids)

    known = BoundedTable(piece_ids, limit)  # bytes take a third of the room of tuples, and are joined faster

    def encode(text: str) -> np.ndarray:
        plain = text.isascii()
        if not (plain or settled(text)) or any(x in text for x in specials):
            return np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(known.__getitem__, (ascii_pieces if plain else pieces)(text))), "<u4")

    return encode


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) → pieces of at most `capacity` tokens, the end token included. Only
    documents over capacity are cut; their first piece takes what does not fill a sequence."""
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int64()))] * with_ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        for b in batches:
            out, held = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first if piece == 0 else start + capacity]
                    out.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), *([part] * with_ids)))
                held += with_ids * len(ids) * 4
                if held >= 8 << 20 or len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return arrow_rows(docs.select("doc_id", "text"), rows, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item; items are to come longest first. The bins by room are
    stacks, and the bits of one integer say which rooms exist, so a placement takes constant time."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for k, size in enumerate(lengths.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            b, room, made = made, capacity, made + 1
        bins[k], offsets[k] = b, capacity - room
        if left := room - size:
            stacks[left].append(b)
            rooms |= 1 << left
    return bins, offsets


def pack_round(items: DataFrame, capacity: int, block: int) -> DataFrame:
    """(item, length) → (item, bin, offset, fill): best fit within each partition, `block` items at
    a time. A bin goes by the id of the item at its start; fill is its length in all."""
    schema = pa.schema([("item", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])

    def packed(ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        item, size = np.concatenate(ids), np.concatenate(sizes)
        order = np.lexsort((item, -size))
        item, size = item[order], size[order]
        bins, offset = best_fit(size, capacity)
        name = np.empty(bins.max() + 1, np.int64)
        name[bins[offset == 0]] = item[offset == 0]
        fill = np.bincount(bins, weights=size).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (item, name[bins], offset, fill[bins])], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, n = [], [], 0
        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            sizes.append(b.column(1).to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= block:
                yield packed(ids, sizes)
                ids, sizes, n = [], [], 0
        if n:
            yield packed(ids, sizes)

    return arrow_rows(items.select("item", "length"), rows, "item long, bin long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, block: int = BLOCK) -> DataFrame:
    """pieces (…, length) → the same rows with sequence_id and offset."""
    pieces = materialise(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = materialise(pack_round(pieces, capacity, block), "bins")
    underfull = lambda bins: bins.where((F.col("offset") == 0) & (F.col("fill") < capacity - slack)).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
    rest = underfull(placed)
    moves = rest.select(F.col("item").alias("first"), F.col("item").alias("to"), F.lit(0).cast("long").alias("by"))
    n, k, moved = rest.count(), 0, False
    while n >= 2:
        tasks, k = -(-n // block), k + 1
        packed = materialise(pack_round(rest.repartition(tasks, F.xxhash64("item", F.lit(k))), capacity, block), "merged")
        saved = n - packed.where("offset = 0").count()
        if saved:
            step = packed.select(F.col("item").alias("__item"), F.col("bin").alias("__to"), F.col("offset").alias("__by"))
            next_moves = moves.join(step, F.col("to") == F.col("__item"), "left").select("first", F.coalesce("__to", "to").alias("to"), (F.col("by") + F.coalesce("__by", F.lit(0))).alias("by"))
            moves, moved = materialise(next_moves, "moves"), True
        if tasks == 1 or not saved:
            break
        rest = underfull(packed)
        n = rest.count()
    place = placed.select("item", "bin", "offset")
    if moved:
        place = place.join(moves, F.col("bin") == F.col("first"), "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    return pieces.join(place, "item").select(*[c for c in pieces.columns if c != "item"], F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, path, capacity), capacity)


def default_tokens() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokens())
