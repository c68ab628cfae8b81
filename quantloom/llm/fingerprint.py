"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, DataFrame operations only.

A text is cut into paragraphs: lines, further cut after full stops and after PIECE code points. Each
distinct 64-bit digest falls into one cell in each third of a table; a cell holds a count, the
exclusive or of its digests, and that of their check hashes. A fingerprint is that table as text.

Two versions are compared by subtracting their tables and peeling: a cell with count +-1 whose check
agrees names a digest that only one version has; taken out of its other cells, it may free more.
A table that does not peel empty is retried larger: the digests are dealt by their bits over tables
that expect LOAD each, and a table that still fails is rebuilt with more cells, up to SIZES[-1]
a third; should that fail too, its digests are compared as sets. Likeness is shared digests over all digests.

One shuffle by blocks of neighbouring ids brings each text and its next together; all else happens
in the row, in time n * sqrt(n) for n paragraphs. Blocks of more rows than ids should give them (equal or
null ids) are range-partitioned and written as sorted runs, each a block of its own.

Defined results: a null or empty text has no paragraphs, and two such texts have likeness 1; rows of
equal doc_id are ordered by text hash; null doc_ids come after all others; the next of the last row
is the first, so a single row is its own next; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quantloom.llm.common import materialise, partitions, table

#: Code points of a paragraph at most.
PIECE = 100
#: Cells of a third of a fingerprint, digests expected in a dealt table, cells of its thirds by size.
BASE, LOAD, SIZES = 6, 8, (8, 16, 64, 512)
#: Ids in one block of the neighbour search, and rows from which a block is crowded.
NEAR, CROWD = 128, 2048


# --- tables, as SQL over arrays -------------------------------------------------------------------


def _let(value: str, name: str, body: str) -> str:
    """Bind a value to a name, so that it is computed once however often the body reads it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _digests(text: str) -> str:
    return f"array_distinct(transform(regexp_extract_all({text}, '[^\\\\n.]{{1,{PIECE}}}\\\\.*|\\\\.+', 0), x -> xxhash64(trim(x))))"


def _signed(digests: str, sign: int) -> str:
    return f"transform({digests}, x -> named_struct('d', x, 's', {sign}L))"


def _spots(d: str, m: str) -> str:
    """The digest's cells a, b, c, one in each third of m cells; each m has hash functions of its own."""
    return ", ".join(f"'{f}', cast(pmod(xxhash64({t}, {m}, {d}), {m}) as int) + {t} * {m}" for t, f in enumerate("abc"))


def _built(entries: str, m: str) -> str:
    """The table of signed digests: an array of 3 m cells (n, k, h)."""
    spotted = f"transform({entries}, e -> named_struct('d', e.d, 's', e.s, 'h', xxhash64(99, e.d), {_spots('e.d', m)}))"
    third = lambda f, t: (
        f"transform(sequence({t} * {m}, {t} * {m} + {m} - 1), c -> aggregate(filter(spotted, e -> e.{f} = c), "
        "named_struct('n', 0L, 'k', 0L, 'h', 0L), (z, e) -> named_struct('n', z.n + e.s, 'k', z.k ^ e.d, 'h', z.h ^ e.h)))"
    )
    return _let(spotted, "spotted", f"concat({', '.join(third(f, t) for t, f in enumerate('abc'))})")


def _peeled(cells: str, m: str, steps: str) -> str:
    """(ok, plus, minus): how many digests only the first or only the second version has."""
    pure = f"transform(slice(filter(s.cells, x -> (x.n = 1 OR x.n = -1) AND xxhash64(99, x.k) = x.h), 1, 1), x -> named_struct('n', x.n, 'k', x.k, 'h', x.h, {_spots('x.k', m)}))"
    without = "transform(s.cells, (x, c) -> if(c = p.a OR c = p.b OR c = p.c, named_struct('n', x.n - p.n, 'k', x.k ^ p.k, 'h', x.h ^ p.h), x))"
    after = f"transform({pure}, p -> named_struct('cells', {without}, 'plus', s.plus + if(p.n = 1, 1L, 0L), 'minus', s.minus + if(p.n = -1, 1L, 0L), 'live', true))"
    step = f"if(s.live, coalesce(get({after}, 0), named_struct('cells', s.cells, 'plus', s.plus, 'minus', s.minus, 'live', false)), s)"
    run = f"aggregate(sequence(0, {steps}), named_struct('cells', {cells}, 'plus', 0L, 'minus', 0L, 'live', true), (s, i) -> {step})"
    return _let(run, "r", "named_struct('ok', forall(r.cells, x -> x.n = 0 AND x.k = 0 AND x.h = 0), 'plus', r.plus, 'minus', r.minus)")


def _dealt(entries: str, tables: str) -> str:
    """The digests dealt over about `tables` lists, in two steps of about its square root."""
    inner = "transform(sequence(0, side - 1), j -> filter(mine, e -> pmod(shiftrightunsigned(e.d, 24), side) = j))"
    outer = f"flatten(transform(sequence(0, side - 1), g -> {_let(f'filter({entries}, e -> pmod(e.d, side) = g)', 'mine', inner)}))"
    return _let(f"cast(ceil(sqrt({tables})) as int)", "side", outer)


def _difference(a: str, b: str, table_a: str, table_b: str) -> str:
    """Digests that two versions do not share: by their fingerprints, or else by larger tables."""
    minus = f"zip_with({table_a}, {table_b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"
    first = _peeled(minus, str(BASE), str(3 * BASE))
    sizes = f"array({', '.join(map(str, SIZES))})"
    larger = f"aggregate({sizes}, named_struct('ok', false, 'plus', 0L, 'minus', 0L), (r, m) -> if(r.ok, r, {_peeled(_built('part', 'm'), 'm', 'size(part)')}))"
    entries = f"concat({_signed(a, 1)}, {_signed(b, -1)})"
    of = lambda sign: f"transform(filter(part, e -> e.s = {sign}L), e -> e.d)"
    exact = _let(of(1), "ours", _let(of(-1), "theirs", "size(array_except(ours, theirs)) + size(array_except(theirs, ours))"))
    total = f"aggregate({_dealt('entries', f'greatest(1, size(entries) / {LOAD})')}, 0L, (t, part) -> t + {_let(larger, 'q', f'if(q.ok, q.plus + q.minus, {exact})')})"
    return _let(first, "f", f"if(f.ok, f.plus + f.minus, {_let(entries, 'entries', total)})")


def _likeness(a: str, b: str, differ: str) -> str:
    return f"if(size({a}) + size({b}) = 0, 1D, (size({a}) + size({b}) - {differ}) / (size({a}) + size({b}) + {differ}))"


def _text(cells: str) -> str:
    return f"array_join(transform({cells}, x -> concat(hex(x.n), '.', hex(x.k))), ' ')"


def fingerprint_sql(text: str) -> str:
    """SQL for the fingerprint of a text column."""
    return _let(_digests(f"coalesce({text}, '')"), "a", _text(_built(_signed("a", 1), str(BASE))))


def likeness_sql(text: str, other: str) -> str:
    """SQL for the likeness of two text columns' fingerprints, 0 to 1."""
    tables = lambda a: _built(_signed(a, 1), str(BASE))
    both = _let(_difference("a", "b", tables("a"), tables("b")), "differ", _likeness("a", "b", "differ"))
    return _let(_digests(f"coalesce({text}, '')"), "a", _let(_digests(f"coalesce({other}, '')"), "b", both))


# --- neighbours -----------------------------------------------------------------------------------


def _id_block() -> F.Column:
    """Ascending in descending ids, nulls last."""
    return F.bitwise_not(F.coalesce(F.shiftright("doc_id", NEAR.bit_length() - 1), F.lit(-(2**57)))).alias("ids")


def _next_block(blocks: DataFrame) -> DataFrame:
    """Distinct blocks, by the columns that order them → the same with __<column>s of the next block, and for
    the last one of the first. Blocks are written as sorted runs; what joins the runs is a row for each of
    them, as many as there are partitions."""
    keys = blocks.columns
    runs = blocks.repartitionByRange(partitions(blocks), *keys).withColumn("run", F.spark_partition_id())
    runs = materialise(runs.withColumn("block", F.struct(*keys)), "block-runs")
    inside = runs.select(*keys, "run", F.lead("block").over(W.partitionBy("run").orderBy(*keys)).alias("follower"))
    ends = runs.groupBy("run").agg(F.min("block").alias("head"))
    over = W.orderBy("run")  # a row for each partition
    across = ends.select(F.col("run").alias("__run"), F.coalesce(F.lead("head").over(over), F.first("head").over(over.rowsBetween(W.unboundedPreceding, W.currentRow))).alias("__next"))
    found = inside.join(F.broadcast(across), F.col("run") == F.col("__run")).select(*keys, F.coalesce("follower", "__next").alias("f"))
    return found.select(*keys, *(F.col(f"f.{k}").alias(f"__{k}") for k in keys))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by descending doc_id; nulls become ''."""
    n, keys = partitions(docs), ["ids"]
    counts = materialise(docs.groupBy(_id_block()).agg(F.count(F.lit(1)).alias("n")), "blocks")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _id_block())
    blocks, crowded = counts.select("ids"), counts.where(F.col("n") > CROWD).select("ids")
    if not crowded.isEmpty():
        keys, one = ["ids", "part"], F.lit(0).alias("part")
        many = rows.join(crowded, "ids", "left_semi").withColumn("copy", F.monotonically_increasing_id())
        many = many.repartitionByRange(n, "ids", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "copy")
        many = materialise(many.select("doc_id", "text", "ids", F.spark_partition_id().alias("part")), "crowded")
        blocks = counts.where(F.col("n") <= CROWD).select("ids", one).union(many.select("ids", "part").distinct())
        rows = rows.join(crowded, "ids", "left_anti").select("doc_id", "text", "ids", one).union(many)
    rows = rows.repartition(n, *keys)
    order = W.partitionBy(*keys).orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    near = rows.select(*keys, "doc_id", "text", F.lead("text").over(order).alias("near"))
    firsts = rows.select(*keys, "text", F.row_number().over(order).alias("rank"), "doc_id").where("rank = 1")
    firsts = firsts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("text").alias("__text"))
    heads = _next_block(blocks).join(firsts, [f"__{k}" for k in keys])
    heads = heads.select(*(F.col(k).alias(f"__of_{k}") for k in keys), "__text").repartition(n, *(f"__of_{k}" for k in keys))
    joined = near.join(heads.hint("merge"), [F.col(k) == F.col(f"__of_{k}") for k in keys], "left")
    return joined.select("doc_id", "text", F.coalesce("near", "__text").alias("next_text"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything of a row in one expression: the tables of the text, of its edited text and of the next."""
    rows = with_next(table(spark, sf_dir, "documents"))
    tables = lambda a: _built(_signed(a, 1), str(BASE))
    result = f"""named_struct(
        'edited_sha256', sha2(edited, 256), 'fingerprint', {_text('ta')}, 'edited_fingerprint', {_text('te')},
        'near_edited', {_let(_difference('a', 'e', 'ta', 'te'), 'differ', _likeness('a', 'e', 'differ'))},
        'near_next', {_let(_difference('a', 'b', 'ta', tables('b')), 'differ', _likeness('a', 'b', 'differ'))})"""
    for value, name in ((tables("e"), "te"), (tables("a"), "ta"), (_digests("next_text"), "b"), (_digests("edited"), "e"), (_digests("text"), "a")):
        result = _let(value, name, result)
    third = "cast(char_length(text) div 3 as int)"
    edited = f"concat(substring(text, 1, char_length(text) - {third}), substring(next_text, 1, {third}))"
    made = rows.select("doc_id", F.expr("cast(char_length(text) as bigint)").alias("n_chars"), F.expr(_let(edited, "edited", result)).alias("r"))
    return made.select("doc_id", "n_chars", "r.edited_sha256", "r.fingerprint", "r.edited_fingerprint", "r.near_edited", "r.near_next")
