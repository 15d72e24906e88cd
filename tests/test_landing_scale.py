"""Landing and joins whose tasks don't grow with the tables, on rows of their own."""

import datetime

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from carrylens.sources import landing
from carrylens.sources import standins as S

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """Own line items, orders and customers: null and doubled keys, orders without customer."""
    day = datetime.datetime(1996, 3, 4)
    lines = [dict(l_orderkey=k, l_suppkey=k and k % 3, l_linenumber=n, l_extendedprice=10.25 * n, l_discount=0.05, l_tax=0.08, l_returnflag="NAR"[n % 3], l_linestatus="OF"[n % 2], l_shipdate=day) for k in (0, 1, 1, 2, 7, None) for n in (1, 2, 3, 4)]
    orders = [dict(o_orderkey=k, o_custkey=c) for k, c in ((0, 1), (1, 1), (2, 5), (2, 6), (3, 1), (None, 1), (7, None))]
    customers = [dict(c_custkey=k, c_mktsegment=s) for k, s in ((1, "BUILDING"), (1, "HOUSEHOLD"), (6, None), (None, "BUILDING"))]
    for name, rows in (("lineitem", lines), ("orders", orders), ("customer", customers)):
        schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
        full = [tuple(int(v) if v is not None and f.dataType.typeName() in ("integer", "long") else v for f in schema for v in [r.get(f.name)]) for r in rows]
        spark.createDataFrame([], schema).unionByName(spark.createDataFrame(full, schema)).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), lines, orders, customers


def test_lines_move_once_in_parts_that_grow_with_the_files(spark, tables, monkeypatch):
    path, lines, orders, customers = tables
    monkeypatch.setattr(S, "PART_BYTES", 100)
    s = S.StandIns(spark, path, land=False)
    assert s.parts("lineitem", "orders") > 9
    plan = s.lines._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [l_orderkey" in plan and "hashpartitioning(l_orderkey#" in plan and f", {s.parts('lineitem', 'orders')})" in plan
    want = []
    for x in lines:
        for o in orders:
            if x["l_orderkey"] is not None and x["l_orderkey"] == o["o_orderkey"]:
                segs = [c["c_mktsegment"] for c in customers if c["c_custkey"] is not None and c["c_custkey"] == o["o_custkey"]] or [None]
                want += [(o["o_custkey"], g, round(x["l_extendedprice"] * 100), 5, 8, x["l_returnflag"], x["l_linestatus"], x["l_orderkey"], x["l_suppkey"], x["l_linenumber"]) for g in segs]
    got = [tuple(r) for r in s.lines.drop("l_shipdate").collect()]
    assert len(got) == 36 and sorted(got, key=str) == sorted(want, key=str)


def test_partitioned_tables_are_landed_without_a_sort(spark, tables, monkeypatch):
    path, key, seen, write = tables[0], "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, *a, **k: (seen.append(int(spark.conf.get(key, "0"))), write(w, *a, **k))[1])
    before = spark.conf.get(key, None)
    for name in ("transfers", "raw_logs"):
        got = getattr(S.StandIns(spark, path), name)
        want = getattr(S.StandIns(spark, path, land=False), name)
        assert got.count() and sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert seen == [S.OPEN_FILES] * 3 and spark.conf.get(key, None) == before  # lines, transfers, raw_logs


def test_pages_are_small_and_compressed_and_their_logs_move_in_parts(spark, tmp_path):
    import glob

    lines = spark.range(100).select(F.to_json(F.struct(F.lit("0xA").alias("address"), F.array(F.col("id").cast("string")).alias("topics"), F.lit("0x").alias("data"), (F.col("id") % 40).alias("block_number"), F.lit(1).alias("log_index"))).alias("value")).coalesce(1)
    landing.write_pages(lines, f"{tmp_path}/p1", rows=30)
    landing.write_pages(lines.filter("value like '%7%'").select(F.left("value", F.lit(20)).alias("value")), f"{tmp_path}/p2")
    assert len(glob.glob(f"{tmp_path}/p1/*.txt.gz")) == 4
    pages = landing.read_json_logs(spark, f"{tmp_path}/p1", f"{tmp_path}/p2")
    got, want = landing.landed_logs(pages, 5), landing.landed_logs(pages)
    assert "hashpartitioning(block_number" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 5)" in plan
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 40
