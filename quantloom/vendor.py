"""Registered queries over dated Parquet files as vendors write them, made from the market-shaped tables.

The files have vendor column names and types, other names of the code column, codes that moved or lie above the
ceiling, null codes, and columns that no contract knows. They are written once for each application and folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.bridge import CTES, bridge, market
from quantloom.engine import Engine
from quantloom.operators import Aggregate, Source
from quantloom.plans.frame import EVAL
from quantloom.plans.graph import Model
from quantloom.recipes import metric
from quantloom.sources.catalog import ParquetCatalog

#: Sessions that get files: the first ones of the events, and the one of the orders.
DAYS, ORDER_DAY = 3, "20240102"
_ROOTS: dict[tuple[str, str], str] = {}


def _root(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/vendor-{uuid.uuid4().hex}"
    made = tempfile.mkdtemp(prefix="quantloom-vendor-")  # a local session, as in tests
    atexit.register(shutil.rmtree, made, True)
    return f"file://{made}"


def files(spark: SparkSession, sf_dir: str) -> tuple[Engine, list[str]]:
    """An engine over vendor files, and the sessions that have them."""
    key, days = (spark.sparkContext.applicationId, sf_dir), market(spark, sf_dir)[1][:DAYS]
    if key not in _ROOTS:
        root = _root(spark)
        bars = bridge(spark, sf_dir, "trades_tbar")
        vendor = {"secu_code": "SecuCode", "minute": "MinBar", "price": "Price", "side": "Side", "volume": "Volume", "is_first": "isfirst", "is_last": "islast", "no": "No"}
        stocks = bridge(spark, sf_dir, "universe")
        for k, d in enumerate(days):
            mine = bars.where(F.col("date") == d).drop("date").withColumnsRenamed(vendor).withColumn("Extra", F.lit("x"))
            mine.withColumn("MinBar", F.col("MinBar").cast("int")).write.parquet(f"{root}/data/trades_tbar/{d}.parquet")
            codes = stocks.where(F.col("date") == d).select(F.col("secu_code").alias(("SecuCode", "sec_code", "secu_code")[k]))
            codes.union(codes).write.parquet(f"{root}/data/universe/ex2kamt/{d}.parquet")
            named = F.concat(F.lpad(F.col("secu_code").cast("string"), 6, "0"), F.lit(".SZ")).alias("sec_code")
            spelled = F.lit(f"{d[:4]}-{d[4:6]}-{d[6:]}").alias("trading_day")
            rest = [F.lit(0.5 + j).alias(c) for j, c in enumerate("open high low close shares amount limit_up limit_down adjfactor total_share float_share free_share".split())]
            daily = bridge(spark, sf_dir, "daily_k").where(F.col("date") == d).select(named, spelled, F.col("preclose").cast("double").alias("preclose"), *rest, F.lit(False).alias("isSuspend"), F.lit(False).alias("isST"), F.lit("19990101").alias("list_date"))
            daily.write.parquet(f"{root}/data/daily_k/{d}.parquet")
        trades = bridge(spark, sf_dir, "steptrades").drop("date")
        code = F.when(F.col("deal_id") % 5 == 0, 22).when(F.col("deal_id") % 5 == 1, 600849).when(F.col("deal_id") % 5 == 2, 800001).when(F.col("deal_id") % 5 == 3, None).otherwise(F.col("secu_code"))
        shaped = trades.withColumn("secu_code", code.cast("long")).withColumn("volume", F.col("volume").cast("long")).withColumn("side", F.col("side").cast("string"))
        level2 = {"secu_code": "SecuCode", "deal_time": "DealTime", "buy_id": "BuyID", "sell_id": "SellID", "deal_id": "DealID", "price": "Price", "volume": "Volume", "side": "Side"}
        shaped.withColumnsRenamed(level2).write.parquet(f"{root}/data/steptrades/{ORDER_DAY}.parquet")
        spark.createDataFrame([(d,) for d in days], "trading_day string").write.parquet(f"{root}/external/trading_days.parquet")
        _ROOTS[key] = root
    return Engine(ParquetCatalog(spark, f"{_ROOTS[key]}/data")), days


def _rows(source: str, days: list[str] | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, sessions = files(spark, sf_dir)
        node = Source(source)
        df = engine.frame(Model("q", None, {"value": node}), node, days or sessions).df.drop(EVAL)
        return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

    return query


def _close_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, sessions = files(spark, sf_dir)
    made = engine.collect(Model("close_last", "ex2kamt", {"value": Aggregate("1d", "last")(metric("close")(Source("trades_tbar")))}), sessions)
    return made.withColumn("value", F.round("value", 6))


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, sessions = files(spark, sf_dir)
    seen = [(d, e) for d in sessions[1:] for e in engine.catalog.calendar.previous_sessions(d, 2)]
    return spark.createDataFrame(seen, "eval_date string, date string")


def queries() -> dict:
    return {"file_bars": _rows("trades_tbar"), "file_daily_k": _rows("daily_k"), "file_level2_codes": _rows("steptrades", [ORDER_DAY]), "file_close_last": _close_last, "file_calendar": _calendar}


_FIRST = f"(SELECT DISTINCT date FROM universe ORDER BY date LIMIT {DAYS})"


def oracle_sql() -> dict[str, str]:
    numbers = ", ".join(f"CAST({0.5 + j} AS DOUBLE) AS {c}" for j, c in enumerate("open high low close shares amount limit_up limit_down adjfactor total_share float_share free_share".split()))
    code = "CASE deal_id % 5 WHEN 0 THEN 1872 WHEN 1 THEN 601607 ELSE secu_code END"
    return {
        "file_bars": CTES + f"SELECT secu_code, minute, round(price, 6) AS price, side, round(volume, 6) AS volume, vw_wait_time, is_first, is_last, no, date FROM trades_tbar WHERE date IN {_FIRST}",
        "file_daily_k": CTES + f"SELECT lpad(CAST(secu_code AS VARCHAR), 6, '0') || '.SZ' AS sec_code, date, CAST(preclose AS DOUBLE) AS preclose, {numbers}, false AS isSuspend, false AS isST, '19990101' AS list_date, secu_code FROM daily_k WHERE date IN {_FIRST}",
        "file_level2_codes": CTES + f"SELECT date, CAST({code} AS BIGINT) AS secu_code, deal_time, buy_id, sell_id, deal_id, price, CAST(CAST(volume AS BIGINT) AS DOUBLE) AS volume, side FROM steptrades WHERE deal_id % 5 IN (0, 1, 4)",
        "file_close_last": CTES + "SELECT u.date, u.secu_code, 'close_last' AS factor_name, round(CAST(f.value AS DOUBLE), 6) AS value FROM universe u LEFT JOIN "
        "(SELECT date, secu_code, last(price ORDER BY minute, price, side) FILTER (WHERE price IS NOT NULL) AS value FROM trades_tbar WHERE is_last GROUP BY 1, 2) f "
        f"USING (date, secu_code) WHERE u.date IN {_FIRST}",
        "file_calendar": CTES + f"SELECT a.date AS eval_date, b.date FROM {_FIRST} a JOIN {_FIRST} b ON b.date <= a.date WHERE a.date > (SELECT min(date) FROM universe) AND b.date >= (SELECT max(c.date) FROM {_FIRST} c WHERE c.date < a.date)",
    }
