"""Corpus-wide line deduplication by range-partitioned hashes, DataFrame operations only.

Lines become (128-bit key hash, doc, position) triples, range-partitioned by hash and sorted within
a partition by hash, document and position. A hash never crosses a partition, so first occurrences are
streamed from the sorted rows as they are, with no other exchange. Lines that are so frequent that
one partition would be long are not shuffled at all: their first documents are a pre-aggregated
minimum, and their rows are joined with those by broadcast. (Counts of a sample of rows tell which
lines they are; both ways give the same result.) What comes out is a bitmap per document, not text.

Defined results: a null or empty text is one empty line; a null doc_id neither drops lines nor
makes others drop; repeated rows of one doc_id count as one document, each row by its own text;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantloom.llm.common import BLANKS, ascii_lower, materialise, partitions, table

#: Positions in one word of a bitmap.
WORD = 62
#: A line with over one in HOT_LINES of the rows is kept out of the range partitions; one row in SAMPLE is counted.
HOT_LINES, SAMPLE = 1000, 512


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, text_hash, pos) of every line whose key a smaller doc_id holds too."""
    line = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    key = line.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hashed = key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "pos", "text_hash")
    hashed = materialise(hashed, "line-hashes")  # range bounds are sampled first: texts are read and split once, not twice
    hot = F.broadcast(materialise(frequent_lines(hashed), "frequent-lines"))  # under HOT_LINES

    firsts = hashed.join(hot, "h1").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    at_hot = hashed.join(F.broadcast(firsts), ["h1", "h2"])
    runs = hashed.join(hot, "h1", "left_anti").repartitionByRange(partitions(hashed), "h1", "h2")
    stream = W.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = runs.withColumn("first_doc", F.first("doc_id").over(stream))
    return at_hot.unionByName(inside).where(F.col("doc_id") != F.col("first_doc")).select("doc_id", "text_hash", "pos")


def frequent_lines(hashed: DataFrame) -> DataFrame:
    """(h1) of lines with a share of over 1 / HOT_LINES of the sampled rows."""
    sampled = hashed.where(F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SAMPLE)) == 0)
    least = max(4, sampled.count() // HOT_LINES + 1)
    return sampled.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("h1")


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """Per document with a dropped line: `words`, (word, bits) pairs of its non-zero bitmap words
    in order, and `n_dropped`. A set bit is a dropped position; absent words are all kept."""
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")
    words = dropped.groupBy("doc_id", "text_hash", F.expr(f"cast(pos div {WORD} as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped")
    )


def line_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    return drop_bitmaps(dropped_lines(docs, min_chars))


def kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with `__lines`, `__dropped` and `__kept`, the text without dropped lines; null becomes empty."""
    # one long array per document with gaps filled by zero words; made before the join, so that it is computed once a document
    dense = F.expr("flatten(transform(words, (x, k) -> concat(array_repeat(0L, x.word - coalesce(get(words, k - 1).word, -1) - 1), array(x.bits))))")
    marks = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), dense.alias("__bits"), F.col("n_dropped").alias("__dropped"))
    joined = docs.withColumn("__text_hash", F.xxhash64("text")).join(
        marks, (F.col("doc_id") == F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left"
    )
    lines = split_lines(F.col("text"))
    stays = F.expr(f"filter(split(coalesce(text, ''), '\\n', -1), (x, i) -> coalesce(get(__bits, i div {WORD}), 0L) & shiftleft(1L, i % {WORD}) = 0)")
    kept = F.when(F.col("__bits").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n"))
    return joined.select(
        *docs.columns,
        F.size(lines).cast("long").alias("__lines"),
        F.coalesce("__dropped", F.lit(0).cast("long")).alias("__dropped"),
        kept.alias("__kept"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out of `text` and `n_chars` set anew where a line went; the
    row stays even if no line does. All columns come through, in order."""
    done = kept_text(docs, line_bitmaps(docs))
    went = F.col("__dropped") > 0
    new = {"text": F.when(went, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(went, F.char_length("__kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return kept_text(docs, line_bitmaps(docs)).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT d.doc_id, d.pos, d.line, coalesce(f.first_doc <> d.doc_id, false) AS gone
  FROM keyed d LEFT JOIN firsts f ON d.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
