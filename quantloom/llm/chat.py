"""Chat formatting with cumulative-snapshot collapse, DataFrame operations only.

Logs hold a conversation once after every turn, so most rows are prefixes of longer ones. Each turn
gets the rolling hash of the turns up to it: the exclusive or of 128-bit hashes of (position, role,
text). A conversation whose last rolling hash is a proper prefix's hash of another one is dropped by
an anti-join; of equal conversations the smallest conv_id stays. What is maximal is rendered.

Turns are range-partitioned by conversation, turn and content, so that a conversation with a great share
of all rows, even under one turn number, is spread over many runs. Running sums go over the turns of a
run and then over the runs' totals. Text is read twice and shuffled once, for the conversations that
stay; everything else moves numbers only. A conversation is rendered in blocks of BLOCK turns, which are
then joined: a rendered conversation is one value, so it is bounded by Spark's 2 GB for a value.

Defined results: turns are ordered by number, nulls first, equal numbers by the MD5 of role and text;
rows with a null conv_id belong to no conversation and go; a null role or text differs from an empty one but
renders as empty; repeated rows are turns of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantloom.llm.common import materialise, partitions, table

#: Turns of a conversation that are rendered together.
BLOCK = 1024
#: A turn's content as 32 hex digits, the same text for Spark and DuckDB.
CONTENT = "md5(coalesce('1' || cast({bytes}(role) as string) || ':' || role, '0') || coalesce('1' || text, '0'))"


def _content() -> Column:
    return F.unhex(F.expr(CONTENT.format(bytes="octet_length")))


def _place(turn: str = "turn") -> Column:
    """What turns of a conversation are ordered by, as one value."""
    return F.struct(F.col(turn).isNotNull().alias("told"), F.coalesce(F.col(turn).cast("long"), F.lit(0).cast("long")).alias("turn"), F.col("content").alias("content"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, pos, h1, h2): the rolling hash of each conversation's first pos turns, and the place of
    the last of them. Empty for an empty table; null conv_ids have none."""
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", _content().alias("content"))
    rows = materialise(rows.select("conv_id", _place().alias("place"), F.monotonically_increasing_id().alias("copy")), "turns")
    runs = rows.repartitionByRange(partitions(rows), "conv_id", "place", "copy").withColumn("run", F.spark_partition_id())
    runs = materialise(runs, "turn-runs")
    in_run = W.partitionBy("conv_id", "run")
    before = W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    up_to = lambda order: in_run.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = runs.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(F.col("conv_id").alias("__c"), F.col("run").alias("__r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__skip"))
    numbered = runs.withColumn("rank", F.count(F.lit(1)).over(up_to(["place", "copy"])))
    placed = numbered.join(offsets, (F.col("conv_id") == F.col("__c")) & (F.col("run") == F.col("__r")))
    pos = (F.col("rank") + F.col("__skip")).alias("pos")
    hashed = placed.select("conv_id", "run", "place", pos, F.xxhash64(pos, "place.content").alias("g1"), F.xxhash64(F.lit(7), "place.content", pos).alias("g2"))
    running = hashed.select("conv_id", "run", "place", "pos", F.bit_xor("g1").over(up_to(["pos"])).alias("r1"), F.bit_xor("g2").over(up_to(["pos"])).alias("r2"))
    totals = hashed.groupBy("conv_id", "run").agg(F.bit_xor("g1").alias("t1"), F.bit_xor("g2").alias("t2"))
    carried = totals.select(
        F.col("conv_id").alias("__c"), F.col("run").alias("__r"),
        F.coalesce(F.bit_xor("t1").over(before), F.lit(0)).alias("__o1"), F.coalesce(F.bit_xor("t2").over(before), F.lit(0)).alias("__o2"),
    )
    joined = running.join(carried, (F.col("conv_id") == F.col("__c")) & (F.col("run") == F.col("__r")))
    return joined.select("conv_id", "place", "pos", F.col("r1").bitwiseXOR(F.col("__o1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("__o2")).alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, bounds) of the conversations that are no prefix of another and no later copy; bounds
    are the places at which blocks of BLOCK turns begin after the first, null if there is but one block."""
    prefixes = materialise(prefix_hashes(turns), "prefixes")
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("w"))
    distinct = whole.groupBy("w").agg(F.min("conv_id").alias("conv_id")).select("conv_id", "w.pos", "w.h1", "w.h2")
    lengths = whole.select(F.col("conv_id").alias("__c"), F.col("w.pos").alias("__n"))
    proper = prefixes.join(lengths, (F.col("conv_id") == F.col("__c")) & (F.col("pos") < F.col("__n"))).select("pos", "h1", "h2").distinct()
    kept = distinct.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))
    bounds = prefixes.where((F.col("pos") % BLOCK == 1) & (F.col("pos") > 1)).groupBy(F.col("conv_id").alias("__c")).agg(F.sort_array(F.collect_list("place")).alias("bounds"))
    return kept.join(bounds, F.col("conv_id") == F.col("__c"), "left").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "bounds")


def render(turns: DataFrame, kept: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, text) of the kept conversations in chat markup, a row each."""
    mine = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text", _content().alias("content")).join(kept, "conv_id")
    said = mine.select("conv_id", "n_turns", F.struct(_place().alias("place"), "role", "text").alias("said"), "bounds")
    block = F.when(F.col("bounds").isNull(), 0).otherwise(F.size(F.filter("bounds", lambda b: b <= F.col("said.place"))))
    one = lambda x: F.concat(F.lit(start), F.coalesce(x.role, F.lit("")), F.lit("\n"), F.coalesce(x.text, F.lit("")), F.lit(end + "\n"))
    # of a block's turns, and turns equal in all
    blocks = said.groupBy("conv_id", "n_turns", block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("said")), one), "").alias("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x.text), "")
    return blocks.groupBy("conv_id", "n_turns").agg(joined.alias("text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return render(turns, maximal_conversations(turns))


SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text, {CONTENT.format(bytes="strlen")} AS content FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, content) AS turns
  FROM c GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, any_value(n) AS n, turns FROM s GROUP BY turns),
p AS (SELECT DISTINCT list_slice(turns, 1, i) AS turns FROM (SELECT turns, unnest(range(1, n)) AS i FROM s)),
m AS (SELECT k.conv_id, k.n FROM k LEFT JOIN p ON k.turns = p.turns WHERE p.turns IS NULL)
SELECT c.conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || coalesce(c.role, '') || chr(10) || coalesce(c.text, '') || '<|im_end|>' || chr(10), ''
                  ORDER BY c.turn NULLS FIRST, c.content) AS text
FROM c JOIN m ON c.conv_id = m.conv_id GROUP BY c.conv_id
"""
