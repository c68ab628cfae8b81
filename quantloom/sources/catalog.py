"""Where frames come from: dated Parquet files, or DataFrames registered by name."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.plans.graph import BAR
from quantloom.sources.contracts import COLUMNS, KEYS, LEVEL2, MAX_CODE, RENAMES, TRANSFER_CODES, level2_type
from quantloom.sources.market import MinuteCalendar, TradingCalendar

logger = logging.getLogger(__name__)


def normalise(df: DataFrame, source: str, date: str | None = None) -> DataFrame:
    """Vendor names, types and codes to the engine's; idempotent on frames that have them already."""
    df = df.withColumnsRenamed({a: b for a, b in RENAMES.items() if a in df.columns and b not in df.columns})
    code = lambda c: F.substring(F.col(c).cast("string"), 1, 6).cast("long")
    new = {}
    if "secu_code" in df.columns or "sec_code" in df.columns:
        new["secu_code"] = code("secu_code" if "secu_code" in df.columns else "sec_code")
    if "date" in df.columns:
        new["date"] = F.replace(F.col("date").cast("string"), F.lit("-"), F.lit(""))
    elif date is not None:
        new["date"] = F.lit(date)
    new |= {c: F.col(c).cast(t) for c, t in (("minute", "long"), ("is_first", "boolean"), ("is_last", "boolean")) if c in df.columns}
    new |= {c: F.col(c).cast(t) for c in df.columns if (t := level2_type(source, c))}
    df = df.withColumns(new)
    if source in LEVEL2:
        moved = F.create_map(*(F.lit(x).cast("long") for pair in TRANSFER_CODES.items() for x in pair))
        df = df.withColumn("secu_code", F.coalesce(F.try_element_at(moved, "secu_code"), "secu_code")).where(F.col("secu_code") <= MAX_CODE)
    return df


def codes(df: DataFrame, name: str, date: Column) -> DataFrame:
    """(date, secu_code) of a universe file, whatever its code column is called."""
    column = next((c for c in ("secu_code", "SecuCode", "sec_code") if c in df.columns), None)
    if column is None:
        raise ValueError(f"universe {name!r} has no code column; it has {df.columns}")
    return df.select(date.alias("date"), F.substring(F.col(column).cast("string"), 1, 6).cast("long").alias("secu_code"))


class Catalog:
    """Contracts, minute validation, universes and sessions over whatever `raw` reads."""

    def __init__(self, spark: SparkSession, minutes: MinuteCalendar | None = None, *, validate: bool = True) -> None:
        self.spark, self.minutes, self.validate = spark, minutes or MinuteCalendar(), validate
        self._checked: set[tuple[str, str]] = set()
        self._scans: dict[tuple[str, tuple[str, ...]], DataFrame] = {}

    def raw(self, source: str, date: str) -> DataFrame:
        raise NotImplementedError

    def schema(self, source: str, dates: list[str]) -> list[str]:
        """A source's columns: by contract, or else as the files have them."""
        return COLUMNS.get(source) or self.scan(source, dates).columns

    def identity_keys(self, source: str) -> tuple[str, ...]:
        if source not in KEYS:
            raise ValueError(f"source {source!r} has no registered identity keys")
        return KEYS[source]

    def checked(self, df: DataFrame, source: str, dates: list[str], date: str | None = None) -> DataFrame:
        """Normalised rows in contract order; raises if columns are missing or minutes off the calendar."""
        df = normalise(df, source, date)
        if lost := [c for c in COLUMNS.get(source, []) if c not in df.columns]:
            logger.error("source %s of %s lacks %s", source, dates[0], lost)
            raise ValueError(f"source {source!r} of {dates[0]} lacks columns {lost}; it has {df.columns}")
        if "minute" in df.columns and self.validate:
            self._check_minutes(df, source, dates)
        return df.select(*COLUMNS.get(source, df.columns))

    def _check_minutes(self, df: DataFrame, source: str, dates: list[str]) -> None:
        """One job for all dates that were not checked before."""
        new = [d for d in dates if (source, d) not in self._checked]
        off = df.where(F.col("date").isin(new) & F.col("minute").isNotNull() & ~F.col("minute").isin(self.minutes.minbars()))
        if new and (bad := [(r.date, r.minute) for r in off.select("date", "minute").distinct().limit(5).collect()]):
            raise ValueError(f"source {source!r} has minutes off the calendar: {sorted(bad)}")
        self._checked |= {(source, d) for d in new}

    def scan(self, source: str, dates: list[str]) -> DataFrame:
        """All rows of a source on some dates, in one DataFrame; columns a date lacks are null."""
        key = (source, tuple(dates))
        if key not in self._scans:
            self._scans[key] = self._scan(source, dates)
        return self._scans[key]

    def _scan(self, source: str, dates: list[str]) -> DataFrame:
        parts = [self.checked(self.raw(source, d), source, [d], d) for d in dates]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def universe(self, name: str, dates: list[str]) -> DataFrame:
        """(date, secu_code) of a universe on some dates, each once."""
        parts = [codes(self.raw(f"universe/{name}", d), name, F.lit(d)) for d in dates]
        return reduce(DataFrame.unionByName, parts).distinct()

    @cached_property
    def calendar(self) -> TradingCalendar:
        return TradingCalendar(self._sessions())

    def _sessions(self) -> list[str]:
        raise NotImplementedError


class ParquetCatalog(Catalog):
    """One Parquet file for each source and date: root/source/YYYYMMDD.parquet; sessions beside root.

    Only the files of the dates asked for are listed. Files of one schema are one Spark scan, so a plan
    over many dates does not grow with their number.
    """

    def __init__(self, spark: SparkSession, root: str, minutes: MinuteCalendar | None = None, *, calendar_path: str | None = None, validate: bool = True) -> None:
        super().__init__(spark, minutes, validate=validate)
        self.root = str(root).rstrip("/")
        self.calendar_path = calendar_path or f"{self.root}/../external/trading_days.parquet"

    def _path(self, source: str, date: str) -> str:
        return f"{self.root}/{source}/{date}.parquet"

    def _by_schema(self, source: str, dates: list[str]) -> list[tuple[DataFrame, list[str]]]:
        """One DataFrame, with __file_date, for the dates whose files have the same schema."""
        with ThreadPoolExecutor(8) as pool:
            schemas = list(pool.map(lambda d: self.raw(source, d).schema, dates))
        alike: dict[str, list[str]] = {}
        for d, schema in zip(dates, schemas, strict=True):
            alike.setdefault(schema.json(), []).append(d)
        named = F.regexp_extract("_metadata.file_path", r"/([^/]+)\.parquet(?:/[^/]*)?$", 1)
        read = lambda days: self.spark.read.schema(schemas[dates.index(days[0])]).parquet(*(self._path(source, d) for d in days))
        return [(read(days).withColumn("__file_date", named), days) for days in alike.values()]

    def _scan(self, source: str, dates: list[str]) -> DataFrame:
        parts = []
        for df, days in self._by_schema(source, dates):
            if not {"date", "trading_day"} & set(df.columns):
                df = df.withColumn("date", F.col("__file_date"))
            parts.append(self.checked(df.drop("__file_date"), source, days))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def universe(self, name: str, dates: list[str]) -> DataFrame:
        parts = [codes(df, name, F.col("__file_date")) for df, _ in self._by_schema(f"universe/{name}", dates)]
        return reduce(DataFrame.unionByName, parts).distinct()

    def raw(self, source: str, date: str) -> DataFrame:
        path = self._path(source, date)
        try:
            return self.spark.read.parquet(path)
        except (AnalysisException, Py4JJavaError) as bad:
            if "PATH_NOT_FOUND" in str(bad) or "does not exist" in str(bad):
                raise FileNotFoundError(path) from bad
            raise

    def _sessions(self) -> list[str]:
        df = self.spark.read.parquet(self.calendar_path)
        column = next((c for c in ("date", "trading_day") if c in df.columns), None)
        if column is None:
            raise ValueError(f"the trading calendar has neither date nor trading_day: {df.columns}")
        return [r[0] for r in df.select(F.col(column).cast("string")).distinct().collect()]  # a few thousand days


class TableCatalog(Catalog):
    """Sources that are DataFrames with a date column, such as partitioned tables or views, or functions
    that make them. A scan is one filter on date, which prunes partitions; nothing is read date by date."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]], sessions: list[str], minutes: MinuteCalendar | None = None, *, validate: bool = False) -> None:
        super().__init__(spark, minutes, validate=validate)
        self.tables, self.days = dict(tables), sessions

    def raw(self, source: str, date: str) -> DataFrame:
        return self._table(source).where(F.col("date") == date)

    def _table(self, source: str) -> DataFrame:
        if source not in self.tables:
            raise FileNotFoundError(f"no table is registered for {source!r}")
        if not isinstance(self.tables[source], DataFrame):
            self.tables[source] = self.tables[source]()
        return self.tables[source]

    def _scan(self, source: str, dates: list[str]) -> DataFrame:
        table = self._table(source)
        if dict(table.dtypes).get("date") == "string":  # the column as it is stored, so that the filter reaches the files
            return self.checked(table.where(F.col("date").isin([*dates, *(f"{d[:4]}-{d[4:6]}-{d[6:]}" for d in dates)])), source, dates)
        return self.checked(table, source, dates).where(F.col("date").isin(dates))

    def universe(self, name: str, dates: list[str]) -> DataFrame:
        table = self._table(f"universe/{name}")
        return table.where(F.col("date").isin(dates)).select("date", F.col("secu_code").cast("long").alias("secu_code")).distinct()

    def _sessions(self) -> list[str]:
        return self.days


def needs_minute(columns: tuple[str, ...], what: str) -> None:
    if lost := [c for c in BAR if c not in columns]:
        raise ValueError(f"{what} needs minute bars; the input lacks {lost}")
