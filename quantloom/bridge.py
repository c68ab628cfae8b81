"""Market-shaped tables over the driver's tables, in SQL that Spark and DuckDB both read.

The order-book prices, level by level, come from a template; the rest is one chain of common table
expressions that queries and oracles share.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quantloom.engine import Engine
from quantloom.sources.catalog import TableCatalog

_EVENTS = """
base AS (
  SELECT event_id, replace(substring(CAST(ts AS STRING),1,10),'-','') AS date,
         CAST(user_id % 8 AS BIGINT) AS secu_code,
         CAST(floor((hour(ts)*60+minute(ts))*239/1440) AS BIGINT) AS slot,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS price,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(1 + event_id % 10 AS DOUBLE) END AS volume,
         CAST(event_id % 2 AS BIGINT) AS side
  FROM events),
tick AS (
  SELECT event_id, date, secu_code, price, volume, side,
         CAST(CASE WHEN slot = 0 THEN 925 WHEN slot = 238 THEN 1500
              WHEN slot <= 120 THEN floor((569+slot)/60)*100 + (569+slot)%60
              ELSE floor((659+slot)/60)*100 + (659+slot)%60 END AS BIGINT) AS minute
  FROM base),
tbar0 AS (
  SELECT date, secu_code, minute, price, side, sum(volume) AS volume, count(*) AS no,
         min(event_id) AS f, max(event_id) AS l
  FROM tick GROUP BY date, secu_code, minute, price, side),
trades_tbar AS (
  SELECT secu_code, minute, price, side, volume, CAST(0 AS DOUBLE) AS vw_wait_time,
         f = min(f) OVER (PARTITION BY date, secu_code, minute) AS is_first,
         l = max(l) OVER (PARTITION BY date, secu_code, minute) AS is_last,
         no, date
  FROM tbar0),
universe AS (
  SELECT d.date, u.secu_code FROM (SELECT DISTINCT date FROM base) d
  CROSS JOIN (SELECT DISTINCT CAST(user_id % 10 AS BIGINT) AS secu_code FROM events) u),
daily_k AS (SELECT date, secu_code, 10.0 + secu_code AS preclose FROM universe)"""

_ORDERS = """
ord AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 1 + o_orderkey % 3 ELSE 600000 + o_orderkey % 3 END AS secu_code,
         o_orderkey AS order_id,
         CASE WHEN o_orderkey % 2 = 0
              THEN CASE o_orderkey % 8 WHEN 0 THEN 2 WHEN 2 THEN 12 WHEN 4 THEN 1 ELSE 11 END
              ELSE CASE o_orderkey % 8 WHEN 1 THEN 0 WHEN 3 THEN 10 WHEN 5 THEN -1 ELSE -11 END END AS order_type,
         CASE WHEN o_orderkey % 3 = 0 THEN 46800 + (o_orderkey*37) % 7000 ELSE 34200 + (o_orderkey*37) % 7200 END AS s,
         CAST(1000 + o_custkey % 20 AS BIGINT) AS price, CAST(100 + o_orderkey % 7 AS DOUBLE) AS volume
  FROM orders),
li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_quantity) AS q
       FROM lineitem GROUP BY l_orderkey, l_linenumber),
dl AS (
  SELECT o.secu_code, o.order_id, o.order_type, li.l_linenumber AS ln, li.pk, li.q, o.s AS os,
         least(54000, CASE WHEN o.s < 41400 AND o.s + li.l_linenumber*1811 >= 41400
               THEN o.s + li.l_linenumber*1811 + 5400 ELSE o.s + li.l_linenumber*1811 END) AS ds
  FROM li JOIN ord o ON li.l_orderkey = o.order_id),
steporders AS (
  SELECT '20240102' AS date, CAST(secu_code AS BIGINT) AS secu_code,
         CAST((floor(s/3600)*10000 + floor((s%3600)/60)*100 + s%60)*1000 AS BIGINT) AS order_time,
         order_id, CAST(order_type AS BIGINT) AS order_type, price, volume FROM ord),
steptrades AS (
  SELECT '20240102' AS date, CAST(secu_code AS BIGINT) AS secu_code,
         CAST((floor(ds/3600)*10000 + floor((ds%3600)/60)*100 + ds%60)*1000 AS BIGINT) AS deal_time,
         CASE WHEN ln % 2 = 1 THEN order_id WHEN ln = 6 AND secu_code < 600000 THEN 0 ELSE order_id + 1000000 END AS buy_id,
         CASE WHEN ln % 2 = 0 THEN order_id WHEN ln = 7 AND secu_code < 600000 THEN 0 ELSE order_id + 1000000 END AS sell_id,
         order_id*10 + ln AS deal_id,
         CASE WHEN ln >= 6 AND secu_code < 600000 THEN CAST(0 AS BIGINT) ELSE CAST(1000 + pk % 20 AS BIGINT) END AS price,
         q AS volume,
         CAST(CASE WHEN ln = 7 AND secu_code < 600000 THEN -1 WHEN ln = 6 AND secu_code < 600000 THEN -11
              ELSE (ln + 1) % 2 END AS BIGINT) AS side
  FROM dl)"""

_TICKS = """
ob0 AS (
  SELECT date, secu_code, event_id,
         CAST(minute * 100000 + (event_id * 7 % 60) * 1000 + event_id % 1000 AS BIGINT) AS tick_time,
         CASE WHEN event_id % 19 = 0 THEN 0 ELSE 1000 + event_id * 31 % 40 END AS p FROM tick)"""

_LEVEL = """
         CASE WHEN event_id % 29 = 0 OR (event_id % 5 = 0 AND {i} >= 3) THEN 0 ELSE 1000 + event_id * 31 % 40 + {i} END AS AskPrice{i},
         CASE WHEN event_id % 29 = 0 OR (event_id % 7 = 0 AND {i} >= 2) THEN 0 ELSE 1000 + event_id * 31 % 40 - {i} END AS BidPrice{i},
         CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(100 + event_id * {i} % 50 AS DOUBLE) END AS AskVolume{i},
         CASE WHEN event_id % 23 = 1 THEN NULL ELSE CAST(100 + event_id * {i} % 60 AS DOUBLE) END AS BidVolume{i}"""

_BOOK = "orderbook AS (\n  SELECT date, secu_code, tick_time, p AS price," + ",".join(_LEVEL.replace("{i}", str(i)) for i in range(1, 11)) + "\n  FROM ob0)\n"

CTES = "WITH" + ",".join([_EVENTS, _ORDERS, _TICKS, _BOOK])

#: Each table with the expressions and the driver tables that it needs.
TABLES = {t: ([_EVENTS], ["events"]) for t in ("trades_tbar", "universe", "daily_k")}
TABLES |= {t: ([_ORDERS], ["orders", "lineitem"]) for t in ("steporders", "steptrades")} | {"orderbook": ([_EVENTS, _TICKS, _BOOK], ["events"])}


def bridge(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the market tables as a DataFrame."""
    chain, driver_tables = TABLES[table]
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in driver_tables}
    text = "WITH" + ",".join(chain)
    for t in given:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(f"{text} SELECT * FROM {table}", **given)


def market(spark: SparkSession, sf_dir: str) -> tuple[Engine, list[str]]:
    """An engine over the market tables, which are made when they are first read, and its sessions."""
    sessions = _days(spark, sf_dir)
    tables = {t: partial(bridge, spark, sf_dir, t) for t in TABLES if t != "universe"}
    tables["universe/all"] = partial(bridge, spark, sf_dir, "universe")
    tables["daily_k"] = lambda: bridge(spark, sf_dir, "daily_k").selectExpr("*", *(f"cast(null as double) as {c}" for c in _REST))
    return Engine(TableCatalog(spark, tables, sessions)), sessions


_KNOWN: dict[tuple[str, str], list[str]] = {}


def _days(spark: SparkSession, sf_dir: str) -> list[str]:
    """The days of the events; looked up once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KNOWN:
        days = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("replace(substring(cast(ts as string), 1, 10), '-', '') as date").distinct()
        _KNOWN[key] = sorted(r.date for r in days.collect())
    return list(_KNOWN[key])


_REST = "sec_code open high low close shares amount limit_up limit_down isSuspend isST adjfactor total_share float_share free_share list_date".split()
