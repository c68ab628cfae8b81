"""Word-level BPE with forced-boundary splitting, and decoding.

A byte pair that occurs inside no vocabulary token can never be merged across, so it is a certain
cut: the fragments between cuts are encoded independently and their ids concatenated. White
space never survives this tokenizer's word split, so texts are first taken apart at plain spaces and
line feeds. Ids of a short chunk, word and fragment are kept in tables bounded by count and key length;
time is linear in a word's length but for the merges within a fragment. Decoding reads the ids.

Defined results: a null text is empty, with no ids and an empty decoded text; null and repeated
doc_ids keep their rows; strings of special tokens in a text become those tokens, as the library has it;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.common import BoundedTable, arrow_rows, kept_by_worker, table

END = "</w>"
#: Character classes of the word split up to U+00FF, after lower-casing.
LETTERS, NUMBERS, SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\x09-\x0d\x20\x85\xa0"
#: The byte alphabet: printable bytes are themselves, the others the characters from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_NAMES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class WordBpe:
    """Encoder and decoder for a tokenizers-library file whose BPE marks word ends with </w>."""

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("dropout") or spec.get("decoder"):
            raise ValueError(f"{path} is not a word-end BPE without a decoder")
        library = Tokenizer.from_file(path)
        self.normalise, self.pre_tokenise = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocab = model["vocab"]
        names = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.joinable = {t[i : i + 2] for name in self.vocab for t in [name.removesuffix(END)] for i in range(len(t) - 1)}
        # a word's last fragment bears the word end, the others do not
        inner = BPE(vocab=self.vocab, merges=[tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.merge = (inner.tokenize, library.model.tokenize)
        self.inner, self.ends, self.words, self.chunks = BoundedTable(self._inner, limit // 8), BoundedTable(self._end, limit // 8), BoundedTable(self._word, limit // 2), BoundedTable(self._chunk, limit)
        # up to U+00FF normalising is lower-casing and the classes are short; \xaa to \xff letters have two bytes
        self.latin_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+").findall
        self.to_bytes = {c: "".join(BYTE_NAMES[x] for x in chr(c).encode()) for c in range(256) if BYTE_NAMES.get(c) != chr(c) or c > 0x7F}

    def cuts(self, word: str) -> list[str]:
        """The fragments of a word in the byte alphabet: cut where no token has that byte pair."""
        at, found = 0, []
        for i, ok in enumerate(map(self.joinable.__contains__, map(add, word, word[1:])), 1):
            if not ok:
                found.append(word[at:i])
                at = i
        found.append(word[at:])
        return found

    def _inner(self, fragment: str) -> tuple[int, ...]:
        return tuple([t.id for t in self.merge[0](fragment)])

    def _end(self, fragment: str) -> tuple[int, ...]:
        return tuple([t.id for t in self.merge[1](fragment)])

    def _word(self, word: str) -> tuple[int, ...]:
        if all(map(self.joinable.__contains__, map(add, word, word[1:]))):
            return self._end(word)
        *parts, last = self.cuts(word)
        return (*chain.from_iterable(map(self.inner.__getitem__, parts)), *self.ends[last])

    def _chunk(self, chunk: str) -> bytes:
        """Ids (little-endian, 32 bits) of a chunk without plain spaces or line feeds."""
        ids = array("I")
        for k, part in enumerate(self.at_special.split(chunk) if "<|" in chunk else (chunk,)):
            if k % 2:
                ids.append(self.special[part])
            elif part.isascii() or max(part) <= "\xff":
                for w in self.latin_words(part.lower()):
                    ids.extend(self.words[w if w.isascii() and w.isprintable() else w.translate(self.to_bytes)])
            else:
                for w, _ in self.pre_tokenise(self.normalise(part)):
                    ids.extend(self.words[w])
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, filter(None, text.replace("\n", " ").split(" "))))

    def decode(self, ids: bytes) -> str:
        """Token names by id, joined by a space: this tokenizer has no decoder of its own."""
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


@kept_by_worker
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """docs (doc_id, text) → ids and decoded text of the whole text, or their digests alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])])
        for b in batches:
            out, held = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "")
                decoded = bpe.decode(ids)
                if digests:
                    out.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
                else:
                    out.append((doc_id, len(ids) // 4, memoryview(ids).cast("i").tolist(), decoded))
                    held += len(ids) + len(decoded)
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    last = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return arrow_rows(docs.select("doc_id", "text"), rows, f"doc_id long, n_tokens long, {last}")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
