"""JSON landing, stored partitions, 128-bit sets, periods as rows, rules and
pointers: small hand-made cases beside the catalog's oracles."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from carrylens.functions import labels, units
from carrylens.operators import categories, ledger, quality
from carrylens.plans import catalog as C
from carrylens.sources import landing
from carrylens.sources import standins as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------- 128-bit sets
def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_bit_of_128(spark):
    draw = random.Random(1)
    sets = [set(), {0}, {127}, {63, 64}, {30, 32}, set(range(128)), set(range(96, 128)), *({draw.randrange(128) for _ in range(draw.randrange(1, 90))} for _ in range(20))]
    rows = []
    for i, bits in enumerate(sets):
        x = sum(1 << b for b in bits)
        rows.append((i, signed(x >> 64), signed(x & (1 << 64) - 1), f"{x:032x}"))
    df = spark.createDataFrame(rows, "category_id int, hi bigint, lo bigint, want string")
    got = df.select("category_id", "want", units.hex_bitmap("hi", "lo").alias("h"), units.hex_set_bits("want").alias("bits"), units.hex_set_bits(F.upper("want")).alias("upper")).collect()
    for r in got:
        assert r.h == r.want and set(r.bits) == set(r.upper) == sets[r.category_id] and r.bits == sorted(r.bits)


def test_categories_take_hex_and_decimal_bitmaps_alike(spark):
    rows = [(1, (1 << 3) | (1 << 30) | (1 << 100), 1 << 5), (2, 1 << 3, 1 << 6), (3, 0, 0), (4, (1 << 3) | (1 << 125), (1 << 5) | 1)]
    hexed = spark.createDataFrame([(i, f"{a:032x}", f"{b:032x}") for i, a, b in rows], "category_id int, collateral_bitmap string, borrowable_bitmap string")
    dec = spark.createDataFrame([(i, str(a), str(b)) for i, a, b in rows], "category_id int, collateral_bitmap string, borrowable_bitmap string").withColumns(
        {c: F.col(c).cast("decimal(38,0)") for c in ("collateral_bitmap", "borrowable_bitmap")})
    for f in (lambda d: categories.candidates(d, 3, 5).select("category_id"), categories.collateral_members, categories.bit_lists, lambda d: categories.coverage(d, 4)):
        assert sorted(map(str, f(hexed).collect())) == sorted(map(str, f(dec).collect())) != []
    # the two highest bits don't fit a decimal, but 32 digits hold them
    top = spark.createDataFrame([(1, "c" + "0" * 31, "0" * 32)], hexed.schema)
    assert [r.reserve_index for r in categories.collateral_members(top).collect()] == [126, 127]


def test_stand_in_categories_reach_over_bit_nine(spark):
    members = categories.collateral_members(S.StandIns(spark, SF).categories).select("reserve_index").distinct()
    seen = {r[0] for r in members.collect()}
    assert {30, 32, 127} <= seen and any(63 < b < 96 for b in seen)


# ---------------------------------------------------------------- landing
def test_json_pages_with_bad_lines_and_overlap(spark, tmp_path):
    good = '{"address":"0xA","topics":["0xt","0x1"],"data":"0x0%d","block_number":%d,"log_index":%d,"more":1}'
    (tmp_path / "a.json").write_text("\n".join([good % (1, 5, 0), good % (2, 5, 1), "not json", '{"address":"0xb","block_number":']) + "\n")
    (tmp_path / "b.json").write_text("\n".join([good % (2, 5, 1), good % (3, 6, 0), good % (9, 6, 0), '{"address":"0xc","topics":[],"data":"0x","log_index":1}', ""]) + "\n")
    pages = landing.read_json_logs(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert sorted((r.block_number, r.log_index, r.data) for r in landing.landed_logs(pages).collect()) == [(5, 0, "0x01"), (5, 1, "0x02"), (6, 0, "0x03")]
    assert sorted(r.line for r in landing.corrupt_lines(pages).collect()) == ["not json", '{"address":"0xb","block_number":']


def test_a_repeated_run_replaces_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", 10.0), (1, "b", 11.0), (2, "c", 12.0), (None, "d", 13.0)], "year int, k string, v double")
    landing.write_partitions(df, path, ["year"])
    landing.write_partitions(df.filter("year = 1 and k = 'a'").withColumn("v", F.lit(99.0)), path, ["year"])
    back = landing.read_table(spark, path, df.schema)
    assert back.schema.names and sorted((r.k, r.v) for r in back.collect()) == [("a", 99.0), ("c", 12.0), ("d", 13.0)]
    assert "PartitionFilters: [isnotnull(year" in plan(back.filter("year = 2"))


# ---------------------------------------------------------------- periods
def test_periods_overlap_and_leave_holes(spark):
    day = lambda n: dt.date(2020, 1, n)
    periods = spark.createDataFrame([("open", None, day(3)), ("first", day(2), day(6)), ("inner", day(4), day(5)), ("twin", day(10), day(11)), ("also", day(10), day(12)), ("end", day(20), None)],
                                    "label string, since date, until date")
    days = spark.createDataFrame([(day(n),) for n in range(1, 25)] + [(None,)], "day date")
    got = {r.day and r.day.day: r.period for r in labels.period_of(days, "day", periods).collect()}
    want = {1: "open", 2: "first", 3: "first", 4: "inner", 5: "first", 10: "twin", 11: "also"} | {n: "end" for n in range(20, 25)}
    assert got == {n: want.get(n) for n in range(1, 25)} | {None: None}
    assert {r.period for r in labels.period_of(days, "day", periods.limit(0)).collect()} == {None}


# ------------------------------------------------------------------- rules
def test_row_rules_are_one_scan_and_null_is_bad(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    got = quality.row_rules(df, {"negative": F.col("v") < 0, "never": F.lit(False)})
    assert sorted(map(tuple, got.collect())) == [("negative", 3, 2), ("never", 3, 0)]
    assert plan(C.QUERIES["row_rules"](spark, SF)).count("FileScan") == 1
    assert [r.n_checked for r in quality.row_rules(df.limit(0), {"x": F.lit(True)}).collect()] == [0]


def test_pointers_that_are_not_answered(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "d"), ("z", "d"), ("d", "z"), ("self", "self"), ("q", None), (None, "q"), ("y", "b"), ("c", "d")]
    got = quality.asymmetric_pointers(spark.createDataFrame(edges, "source string, target string")).collect()
    assert sorted(map(tuple, got)) == [("c", "d"), ("y", "b")]


# ---------------------------------------------------------------- members
def test_transfers_inside_the_member_set_are_found(spark):
    assert not C.QUERIES["intra_cluster_transfers"](spark, SF).isEmpty()
    t = spark.createDataFrame([("t", "a", "b"), ("t", "a", "x"), ("t", "x", "b"), ("t", "b", "b")], "contract_address string, `from` string, `to` string")
    got = ledger.intra_set_transfers(t, spark.createDataFrame([("a",), ("b",), ("b",)], "address string"))
    assert sorted((r["from"], r["to"]) for r in got.collect()) == [("a", "b"), ("b", "b")]


@pytest.mark.parametrize("key", ["account_leverage", "leverage_histogram"])
def test_account_risk_is_of_loopers_alone(spark, key):
    loopers = C._loopers(S.StandIns(spark, SF)).count()
    everyone = C._accounts(S.StandIns(spark, SF)).count()
    assert loopers < everyone
    rows = C.QUERIES[key](spark, SF).collect()
    assert (len(rows) if key == "account_leverage" else sum(r.n_accounts for r in rows)) <= loopers
