"""Every catalog key against its DuckDB oracle on the smallest tables, the
driver contract, and plan properties that matter at scale."""

import pytest

import __spark_entry__ as E
from tools.parity import compare, duck

from carrylens.plans.catalog import QUERIES as CATALOG  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES = {k: q for k, q in E.queries().items() if k in CATALOG}  # the training-data queries have tests of their own
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_key_has_an_oracle_or_is_documented():
    missing = set(QUERIES) - set(ORACLE)
    assert not missing, missing


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_key_matches_duckdb(spark, con, key):
    ok, msg = compare(spark, con, key, SF, QUERIES, ORACLE)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows and "user_addr" in df.columns


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    from carrylens.sources import standins as S

    plan = _plan(QUERIES["net_debt"](spark, SF))
    # reserve equality reaches the parquet reader; only the used columns are read
    assert f"EqualTo(reserve,{S.ASSET})" in plan
    assert "ReadSchema: struct<reserve:string,on_behalf_of:string,amount:bigint>" in plan
    carry = _plan(QUERIES["latest_per_day"](spark, SF))
    # rate updates are landed partitioned by reserve: the filter prunes directories
    assert "PartitionFilters: [isnotnull(reserve" in carry


def test_leaderboard_has_no_single_partition_window_over_positions(spark):
    plan = _plan(QUERIES["top_loopers"](spark, SF))
    # the only window runs after TakeOrderedAndProject (k rows), never over all positions
    assert "TakeOrderedAndProject" in plan


def test_latest_per_day_uses_max_by_not_a_sort(spark):
    plan = _plan(QUERIES["latest_per_day"](spark, SF))
    assert "max_by" in plan and "Window" not in plan


@pytest.mark.parametrize("key", ["curve_configs", "config_table_text", "fit_gap"])
def test_cluster_is_computed_once(spark, key):
    plan = _plan(QUERIES[key](spark, SF))
    assert plan.count("TakeOrderedAndProject(limit=10") == _plan(QUERIES["cluster_hurdle"](spark, SF)).count("TakeOrderedAndProject(limit=10")


def test_setup_table_names_every_parameter(spark):
    got = {r.param: r.value for r in QUERIES["setup_table"](spark, SF).collect()}
    assert len(got) == 33 and got["active_incentive"] == "none observed" and got["debt_symbol"].endswith("5")
    assert got["block_number"].isdigit() and len(got["block_time_utc"]) == 19


def test_setup_table_of_parts_without_a_row_or_value(spark):
    from carrylens.operators.quality import setup_table

    one = spark.createDataFrame([(7, None, 0.5)], "a bigint, b string, c double")
    got = {r.param: r.value for r in setup_table(one, spark.createDataFrame([], "d timestamp, e string")).collect()}
    assert got == {"a": "7", "b": None, "c": "0.50000000", "d": None, "e": None}


def test_weighted_means_do_not_depend_on_order(spark):
    from pyspark.sql import functions as F

    from carrylens.functions.units import real_sum, weighted_mean

    rows = [(0.1, 1e9), (0.7, 1e-7), (1 / 3, 12345.678), (-0.1, 1e9), (1e6, 0.3)] * 200
    means = set()
    for turned in (rows, rows[::-1], sorted(rows)):
        df = spark.createDataFrame(turned, "x double, w double").repartition(7)
        means.add(tuple(df.agg(weighted_mean("x", "w"), real_sum(F.col("x") * F.col("w"))).first()))
    assert len(means) == 1
    assert spark.createDataFrame([(1.0, 0.0)], "x double, w double").agg(weighted_mean("x", "w")).first()[0] is None
