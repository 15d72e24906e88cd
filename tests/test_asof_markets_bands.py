"""As-of joins and accrual, state at many pins, many markets, bands: against
plain Python and against the single-entity runs, with the plans that matter."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carrylens.operators import asof, bands, markets, series
from carrylens.plans import catalog as C
from carrylens.sources import standins as S
from carrylens.sources.schemas import snapshot_as_of

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ as of
@pytest.mark.parametrize("width", [1, 10, 1000])
def test_asof_join_is_the_last_row_at_or_before(spark, width):
    draw = random.Random(width)
    left = [(draw.choice("abx"), draw.randrange(100), i) for i in range(300)] + [("a", None, 1000), (None, 5, 1001), ("z", 5, 1002), ("a", 5, 1003), ("a", 5, 1003)]
    right = [(draw.choice("aby"), draw.randrange(100), draw.randrange(4), f"v{i}" if i % 5 else None) for i in range(80)] + [(None, 1, 0, "lost"), ("a", None, 0, "lost")]
    got = asof.asof_join(spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, t int, place int, state string"),
                         ["k"], "t", ["state", "place"], lambda c: F.floor(c / width), tie=("place",)).collect()

    def want(k, t):
        # ties in time go to the greatest place, then to the greatest state
        fit = [r for r in right if r[0] == k and None not in (k, t, r[1]) and r[1] <= t]
        best = max(fit, key=lambda r: (r[1], r[2], r[3] is not None, r[3] or ""), default=(None,) * 4)
        return best[3], best[2]

    assert sorted((r.id, r.k or "", r.state or "", -1 if r.place is None else r.place) for r in got) == sorted(
        (i, k or "", want(k, t)[0] or "", -1 if want(k, t)[1] is None else want(k, t)[1]) for k, t, i in left)


def test_asof_join_windows_over_events_are_cut_into_slices(spark):
    x = spark.createDataFrame([("a", 1, 1.0)], "k string, t int, v double")
    windows = [line for line in plan(asof.asof_join(x.drop("v"), x, ["k"], "t", ["v"], lambda c: F.floor(c / 10))).splitlines() if "Window [last(_s" in line]
    # one over (key, slice) for events, one over the key for the summary of slices
    assert len(windows) == 2 and sum("RowFrame, unboundedpreceding" in w and "_kind" in w for w in windows) == 1
    assert all("_slice" in w for w in windows)


def test_accrual_by_hand(spark):
    day = lambda n: dt.datetime(2000, 1, 1) + dt.timedelta(days=n)
    events = spark.createDataFrame(
        [("r", "u", Decimal(1000), day(0)), ("r", "u", Decimal(1000), day(50)), ("r", "u", Decimal(-300), day(50)), ("r", "w", Decimal(70), day(99)), ("q", "u", Decimal(5), day(9))],
        "reserve string, user_addr string, amount decimal(38,0), evt_block_time timestamp_ntz")
    updates = spark.createDataFrame([("r", day(10), 1, 0, 1.1), ("r", day(50), 2, 0, 9.9), ("r", day(50), 2, 3, 1.25), ("r", day(120), 7, 0, 1.5)],
                                    "reserve string, evt_block_time timestamp_ntz, evt_block_number bigint, evt_index int, variable_borrow_index double")
    got = {(r.reserve, r.user_addr): r for r in asof.accrued_debt(events, updates, 1.0).collect()}
    assert got["r", "u"].scaled_debt == 1000 + 800 - 240 and got["r", "u"].principal_debt == 1700
    assert got["r", "u"].accrued_debt == pytest.approx(1560 * 1.5) and got["r", "u"].interest == pytest.approx(640)
    assert got["r", "w"].accrued_debt == pytest.approx(84) and got["q", "u"].interest == 0
    assert asof.accrued_debt(events.limit(0), updates, 1.0).collect() == []


def test_reconciliation_sees_the_interest(spark):
    rows = C.QUERIES["reconcile_positions"](spark, SF).collect()
    both = [r for r in rows if r.in_a and r.in_b]
    assert sum(r.abs_gap > 0 for r in both) > 0.9 * len(both) > 0
    assert {r.within_tol for r in both} == {True, False}
    assert any(not r.in_b for r in rows)


# ------------------------------------------------------------------- pins
def test_every_pin_is_a_run_with_that_pin_alone(spark):
    s = S.StandIns(spark, SF)
    cases = [(s.reserve_updates, ["reserve"], "evt_block_number", "evt_index", (100, 700, 10**9)),
             (s.balances, ["token", "address"], "block_number", None, C.SNAPSHOT_PINS), (s.account_words, ["address"], "block_number", None, C.SNAPSHOT_PINS)]
    for df, keys, block, index, pins in cases:
        got = asof.states_at_pins(df, keys, spark.createDataFrame([(p,) for p in pins + pins[:1]], "pin bigint"), block, index)
        for pin in pins:
            one = snapshot_as_of(df, keys, pin, block, index)
            assert sorted(map(str, got.filter(F.col("pin") == pin).select(*one.columns).collect())) == sorted(map(str, one.collect()))
    assert got.filter(F.col("pin") == C.SNAPSHOT_PINS[0]).isEmpty() and not got.isEmpty()


def test_pins_keep_null_states_and_carry_forward(spark):
    states = spark.createDataFrame([("a", 5, "x", 1), ("a", 9, None, 2), ("a", 30, "z", 3), ("b", 40, "late", 4)], "k string, b bigint, v string, n int")
    got = asof.states_at_pins(states, ["k"], spark.createDataFrame([(4,), (5,), (20,), (29,), (30,)], "pin bigint"), "b").collect()
    assert sorted((r.pin, r.k, r.v or "-", r.n) for r in got) == [(5, "a", "x", 1), (20, "a", "-", 2), (29, "a", "-", 2), (30, "a", "z", 3)]


# ---------------------------------------------------------------- markets
def test_two_markets_in_one_run_are_two_single_runs(spark):
    s = S.StandIns(spark, SF)
    both = C.QUERIES["carry_markets"](spark, SF).collect()
    for name, p in C.MARKETS.items():
        single = series.carry_daily(spark, s.reserve_updates, s.transfers, p, C.PERIODS, C.LAST_PERIOD).collect()
        mine = sorted((r for r in both if r.market == name), key=lambda r: r.day)
        assert len(mine) == len(single) > 0
        for a, b in zip(mine, single):
            for c in single[0].__fields__:
                assert a[c] == (pytest.approx(b[c], rel=1e-9) if isinstance(b[c], float) else b[c]), (name, b.day, c)


def test_options_of_each_market_are_its_own(spark):
    import dataclasses

    s = S.StandIns(spark, SF)
    odd = {"fill": dataclasses.replace(C.MARKETS["second"], forward_fill_rates=True), "raw": dataclasses.replace(C.CARRY, amounts_are_scaled=False)}
    both = markets.carry_markets(s.reserve_updates, s.transfers, markets.market_table(spark, odd), C.PERIODS, C.LAST_PERIOD).collect()
    for name, p in odd.items():
        single = series.carry_daily(spark, s.reserve_updates, s.transfers, p, C.PERIODS, C.LAST_PERIOD).collect()
        mine = sorted((r for r in both if r.market == name), key=lambda r: r.day)
        assert [(r.day, round(r.total_supply, 6), r.vault_apy_30d) for r in mine] == [(r.day, round(r.total_supply, 6), r.vault_apy_30d) for r in single]


def test_carry_scans_transfers_once(spark):
    for key in ("carry_daily", "carry_markets"):
        scans = [line for line in plan(C.QUERIES[key](spark, SF)).splitlines() if "FileScan" in line]
        assert sum("from" in x and "value" in x for x in scans) == 1, scans


def test_windows_are_partitioned_by_market(spark):
    assert "SinglePartition" not in plan(C.QUERIES["running_balances_markets"](spark, SF))


# ------------------------------------------------------------------ bands
def numbers(spark, seed, n=500):
    draw = random.Random(seed)
    rows = [(i, draw.choice([7, 7, 7, draw.randrange(50), None]), Decimal(draw.randrange(10**20)) if draw.random() < 0.8 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, v int, w decimal(38,0)")


@pytest.mark.parametrize("n_bands", [1, 2, 13])
def test_banded_rank_is_the_plain_window(spark, n_bands):
    _, df = numbers(spark, n_bands)
    for up in (True, False):
        order = [F.col("v").asc_nulls_last() if up else F.col("v").desc_nulls_last(), F.col("id").asc()]
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        want = df.select("*", F.row_number().over(w).cast("bigint").alias("rank"), F.sum("w").over(w).alias("cum"))
        got = bands.banded_rank(df, [("v", up), ("id", True)], {"cum": F.col("w")}, bands=n_bands)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 501])
def test_banded_median_is_the_median(spark, n):
    import statistics

    rows, df = numbers(spark, n, n)
    values = [r[1] for r in rows if r[1] is not None]
    got = bands.banded_median(df, "v", "id", 9).collect()
    assert [r.median for r in got] == [statistics.median(values) if values else None]


def test_a_value_of_most_rows_does_not_fill_a_band(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5).alias("v"))
    keys = [("v", True), ("id", True)]
    sizes = df.groupBy(bands.band_of(bands.borders(df, keys, 16), keys, df.schema).alias("b")).count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 3 * 4000 / 16


def test_ranking_moves_positions_once_and_writes_used_columns(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(bands, "materialize", lambda df: (seen.append(df), df)[1])
    C.QUERIES["loop_ranking"](spark, SF).collect()
    text = plan(seen[0])
    assert text.count("Exchange hashpartitioning(_band") == 1 and "SinglePartition" not in text.split("Window")[0] and "rangepartitioning" not in text
    assert set(seen[0].columns) == {"user_addr", "is_loop_position", "debt", "debt_raw", "_band", "_place", "_upto__cum_loop"}


def test_median_of_accounts_has_no_global_sort(spark):
    text = plan(C.QUERIES["leverage_stats"](spark, SF))
    assert "rangepartitioning" not in text and "Sort [leverage" not in text.replace("Sort [_band", "")
