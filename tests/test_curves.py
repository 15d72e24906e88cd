"""Rate curve, loop economics and scenario goldens (FIXTURES part C)."""

import pytest
from pyspark.sql import functions as F

from carrylens.functions import curves as c
from carrylens.operators import scenarios

# Fixed golden inputs of the studied cluster: (debt, leverage, health factor)
CLUSTER = [
    (74068359.0, 9.95, 1.023), (50084699.0, 11.73, 1.028), (45096733.0, 12.49, 1.022),
    (34322313.0, 12.42, 1.022), (14200347.0, 12.74, 1.020), (10727582.0, 8.31, 1.046),
    (7959707.0, 12.19, 1.024), (4931008.0, 12.72, 1.020), (4081523.0, 12.28, 1.014),
]


@pytest.fixture()
def stats(spark):
    m = spark.createDataFrame([(f"a{i}", d, L, h) for i, (d, L, h) in enumerate(CLUSTER)],
                              "address string, debt double, leverage double, health_factor double")
    loop = spark.createDataFrame([(295_154_950.0,)], "loop_debt double")
    return scenarios.cluster_stats(m, 0.04, 0.033, loop)


def test_cluster_goldens(stats):
    r = stats.first()
    assert r.cluster_debt == pytest.approx(245_472_271)
    assert r.share_of_loop_debt == pytest.approx(0.831673, abs=1e-6)
    assert r.w_leverage == pytest.approx(11.381920989682781, rel=1e-12)
    assert r.w_hf == pytest.approx(1.0243507463333812, rel=1e-12)
    assert r.hurdle == pytest.approx(0.11267344692777946, rel=1e-12)
    assert (r.roe_min, r.roe_max) == (pytest.approx(0.09117, abs=1e-5), pytest.approx(0.12218, abs=1e-5))


def test_status_quo_and_configs(stats):
    cfgs = [("Status quo", 0.90, 0.04), ("A", 0.80, 0.04), ("B", 0.90, 0.07), ("C", 0.85, 0.055)]
    g = {r.config: r for r in scenarios.config_grid(stats, cfgs, 0.04, scenarios.Curve(), 1e9, "Status quo").collect()}
    assert g["Status quo"].r_star == pytest.approx(0.033, abs=1e-12)  # T23: circular by construction
    assert g["Status quo"].u_star == pytest.approx(0.7425, abs=1e-9)
    assert g["Status quo"].revenue == pytest.approx(6_125_625, abs=1e-3)
    assert g["Status quo"].supply_apy == pytest.approx(0.018376875, abs=1e-12)
    assert g["A"].u_star == pytest.approx(0.66) and g["A"].revenue == pytest.approx(5_445_000)
    assert g["B"].u_star == pytest.approx(0.424285714, abs=1e-9) and g["B"].revenue == pytest.approx(3_500_357.14, abs=0.01)
    assert g["C"].u_star == pytest.approx(0.51) and g["C"].revenue == pytest.approx(4_207_500)
    assert g["A"].revenue_change == pytest.approx(-0.1111, abs=1e-4)
    assert g["B"].u_change_points == pytest.approx(-31.82, abs=0.01)


def test_sensitivity_goldens(stats):
    s = {r.scenario: r for r in scenarios.sensitivity(stats, (1.025, 1.05, 1.10), (10.0, None, 12.0), 0.94, 0.04,
                                                       scenarios.Curve(), 1e9).collect()}
    assert s["HF = 1.1"].L == pytest.approx(6.875)
    assert s["HF = 1.1"].revenue == pytest.approx(4_294_236.10, abs=0.01)
    assert s["HF = 1.05"].L == pytest.approx(9.545454545, abs=1e-9)
    assert s["L = 10x"].HF == pytest.approx(1.044444444, abs=1e-9)
    assert s["L = 10x"].revenue == pytest.approx(5_733_093.62, abs=0.01)
    assert s["L = base"].HF == pytest.approx(1.0243507, abs=1e-7)  # measured, not formula
    assert s["L = 12x"].u_star == pytest.approx(0.751349768, abs=1e-9)
    assert s["HF = 1.025"].revenue == pytest.approx(6_285_725.25, abs=0.01)


def test_sweep_goldens_and_monotone(stats):
    sw = {round(r.slope1, 3): r for r in scenarios.slope_sweep(stats, (0.02, 0.03, 0.034, 0.04, 0.05, 0.07, 0.10, 0.15, 0.20),
                                                             0.04, scenarios.Curve(), 1e9).collect()}
    assert sw[0.02].u_star == pytest.approx(0.910833, abs=1e-6) and sw[0.02].branch == "above kink"
    assert sw[0.034].revenue == pytest.approx(7_206_617.65, abs=0.01)
    assert sw[0.2].revenue == pytest.approx(1_225_125, abs=1e-3)
    x = scenarios.slope_sweep(stats, (0.02, 0.03, 0.04, 0.10), 0.04, scenarios.Curve(), 1e9)
    assert scenarios.monotone(x, "slope1", "revenue").first().is_non_increasing is True


def test_curve_inverse_is_identity_on_both_branches(spark):
    df = spark.createDataFrame([(u,) for u in (0.0, 0.3, 0.9, 0.95, 1.0)], "u double")
    args = (0.0, 0.9, 0.04, 0.12)
    r = df.select("u", c.curve_utilisation(c.curve_rate("u", *args), *args).alias("back")).collect()
    for row in r:
        assert row.back == pytest.approx(row.u, abs=1e-12)


def test_hf_leverage_roundtrip_and_max_leverage(spark):
    df = spark.createDataFrame([(1.025,), (1.05,), (1.1,)], "hf double")
    r = df.select("hf", c.hf_from_leverage(c.leverage_from_hf("hf", 0.94), 0.94).alias("back")).collect()
    for row in r:
        assert row.back == pytest.approx(row.hf, rel=1e-12)
    x = spark.range(1).select(c.max_leverage(F.lit(0.92)).alias("L"), c.loop_roe(c.max_leverage(F.lit(0.92)), 0.04, 0.032).alias("roe")).first()
    assert x.L == pytest.approx(12.5) and x.roe == pytest.approx(0.132)
