"""Every registered query of the engine against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

from quantloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_each_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    made = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(made.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in made.collect())


def test_scan_prunes_and_pushes(spark):
    plan = catalog.queries()["where_side"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "props" not in plan


def test_a_stored_date_column_is_filtered_in_the_files(spark, tmp_path):
    from quantloom import Engine, Model, Source, TableCatalog

    days = ["20240102", "20240103"]
    rows = [(1, d if k else f"{d[:4]}-{d[4:6]}-{d[6:]}", 925, 1.0, 0) for k, d in enumerate(days)]
    spark.createDataFrame(rows, "secu_code long, date string, minute long, price double, side long").selectExpr(
        "*", "1D as volume", "0D as vw_wait_time", "true as is_first", "true as is_last", "1L as no"
    ).write.parquet(f"{tmp_path}/t")
    engine, node = Engine(TableCatalog(spark, {"trades_tbar": spark.read.parquet(f"{tmp_path}/t")}, days)), Source("trades_tbar")
    df = engine.frame(Model("m", None, {"value": node}), node, days[:1]).df
    assert [r.date for r in df.collect()] == days[:1]
    assert "PushedFilters: [In(date, [" in df._jdf.queryExecution().executedPlan().toString()
