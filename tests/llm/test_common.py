"""The shared scratch folder and the folds."""

import os
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quantloom.llm import common


class _Session:
    """A session without the setting, on some master."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master})()
        values = {}
        self.conf = type("Conf", (), {"get": lambda _, k, d=None: values.get(k, d), "set": lambda _, k, v: values.update({k: v})})()


def test_a_cluster_must_name_the_folder():
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.scratch(_Session(master), "x")
    session = _Session("local[8]")
    a, b = common.scratch(session, "x"), common.scratch(session, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] == session.conf.get("spark.checkpoint.dir")
    assert common.scratch(_Session("local"), "x")


def test_materialise_round_trips(spark):
    df = spark.createDataFrame([(1, None, [1, 2]), (2, "é", None)], "a long, b string, c array<int>")
    assert sorted(common.materialise(df, "t").collect()) == sorted(df.collect())
    assert common.materialise(df.limit(0), "t").schema == df.schema


def test_fold(spark):
    ids = [0, 1, 17, 123456789, -4, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(common.held_out(F.col("doc_id")).alias("h")).collect()
    assert [r.h for r in got] == [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


def test_partitions_follow_the_table(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.partitions(df) == session
    monkeypatch.setattr(common, "PARTITION_BYTES", 100)
    assert common.partitions(df) > session and common.partitions(df, 1e9) == common.MAX_PARTITIONS
    assert common.partitions(spark.createDataFrame([(1,)], "a long").where("a > 0")) == session


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A driver that only has the repository on sys.path, in another working folder."""
    root = Path(common.__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
print("ROWS", __spark_entry__.queries()["op9_media_columns"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 200" in done.stdout, done.stderr[-2000:]


def test_a_worker_lets_go_what_another_module_keeps():
    table = common.kept_by_worker(lambda size: bytes(size))
    try:
        mine, other = (lambda batches: batches), (lambda batches: batches)
        other.__module__ = "quantloom.llm.other"
        table(10)
        assert list(common.frugal(mine)(iter([1, 2]))) == [1, 2] and table.cache_info().currsize == 1
        assert list(common.frugal(other)(iter([3]))) == [3] and table.cache_info().currsize == 0
    finally:
        common._kept.remove(table)
    from quantloom.llm import packing

    assert packing.byte_encoder in common._kept
