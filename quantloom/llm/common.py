"""Shared helpers: the shared scratch folder, materialised tables, Arrow functions, joins with hot groups."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the text contracts name: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be invisible to the other executors, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quantloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers once a Spark application, unless PYTHONPATH leads to it."""
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="quantloom-")
    atexit.register(shutil.rmtree, folder, True)
    context.addPyFile(shutil.make_archive(f"{folder}/quantloom", "zip", root, "quantloom"))  # the driver serves it to executors
    _shipped.add(context.applicationId)


_kept: list[Callable] = []


def kept_by_worker(make: Callable) -> Callable:
    """`make` with its last results kept from task to task in a Python worker, until it runs another module's tasks."""
    _kept.append(lru_cache(maxsize=2)(make))
    return _kept[-1]


def frugal(rows: Callable) -> Callable:
    """`rows` for a Python worker: what other modules keep is let go first, and memory that a task has freed goes back
    to the system after it. Else a worker's memory would be the sum of all that it ever ran."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cache in _kept:
            if cache.__module__ != rows.__module__:
                cache.cache_clear()
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        if os.name == "posix" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # of glibc
            trim(0)

    return run


def arrow_rows(df: DataFrame, rows: Callable, schema) -> DataFrame:
    """`mapInArrow`, with the package shipped first: a Python function knows the files sent before it is made."""
    ship(df.sparkSession)
    return df.mapInArrow(frugal(rows), schema)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so a lost
    executor costs a file read, and what later steps see cannot change on a retry."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class BoundedTable(dict):
    """A dict that makes missing values. It holds up to `limit` of them and the generation before, from
    which values come back when they are asked for again. Values of keys of over `longest`
    characters are made each time, so its bytes are bounded whatever the keys."""

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        self.make, self.limit, self.longest, self.before = make, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        value = self.before.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


#: Rows of a group from which it is joined by broadcast, and the most groups that may be.
HOT_ROWS, HOT_GROUPS = 100_000, 1_000_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], hot: int = HOT_ROWS) -> DataFrame:
    """rows left-joined with groups, which has one row for each key and `n`, how many rows have it. A group
    of over `hot` rows goes by broadcast and its rows are not shuffled by the key; there is at most one
    for each `hot` rows, and should there be over HOT_GROUPS, larger ones only are broadcast. Null keys find
    nothing. Columns of groups besides the keys and n come through."""
    large = materialise(groups.where(F.col("n") > hot), "hot-groups")
    while large.count() > HOT_GROUPS:
        hot *= 10
        large = large.where(F.col("n") > hot)
    names = [c for c in groups.columns if c not in (*keys, "n")]
    side = lambda g, tag: g.select(*(F.col(k).alias(f"__{tag}_{k}") for k in keys), *(F.col(c).alias(f"__{tag}_{c}") for c in names), F.lit(True).alias(f"__{tag}"))
    on = lambda tag: [F.col(k) == F.col(f"__{tag}_{k}") for k in keys]
    first = rows.join(F.broadcast(side(large, "h")), on("h"), "left")
    # rows that have found their group get a key of their own that no group has, so they spread
    alone = F.when(F.col("__h").isNull() & F.col(keys[0]).isNotNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*rows.columns).bitwiseOR(F.lit(1)))
    second = side(groups.where(F.col("n") <= hot), "g").withColumn("__g_alone", F.lit(0).cast("long"))
    found = first.withColumn("__alone", alone).join(second, [*on("g"), F.col("__alone") == F.col("__g_alone")], "left")
    return found.select(*rows.columns, *(F.when(F.col("__h"), F.col(f"__h_{c}")).otherwise(F.col(f"__g_{c}")).alias(c) for c in names))


#: Estimated bytes of a partition that is dealt out by number, which adaptive execution cannot split.
PARTITION_BYTES, MAX_PARTITIONS, UNKNOWN_BYTES = 256 << 20, 200_000, 1 << 60


def partitions(table: DataFrame, times: float = 1) -> int:
    """Partitions for dealing out `times` a table read from files: the session's number, or more if
    the files are so large. (Estimates of joins are products, so pass what was read, not what was joined.
    A table of no known size, such as one made from Python rows, gets the session's number.)"""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    session = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return session if size * times >= UNKNOWN_BYTES else max(session, min(MAX_PARTITIONS, int(size * times) // PARTITION_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; `lower` gives the same for pure ASCII and is faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the decimal doc_id, mod 4, is 2. A null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
