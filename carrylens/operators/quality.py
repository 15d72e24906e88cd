"""Checks and parameter reports: reconciliation (J-27), integrity rules
(J-28), staking state (J-26) and the consolidated parameter table (J-29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import ZERO_ADDRESS, r8, safe_div


def reconcile(a: DataFrame, b: DataFrame, key: str, rel_tol: float) -> DataFrame:
    """Same measure from two sources, per entity: full outer join on the key,
    absolute and relative gap, and a tolerance flag (J-27).  Entities missing
    from one side show up with a NULL value and ``within_tol = false``."""
    j = a.withColumn("_in_a", F.lit(True)).join(b.withColumn("_in_b", F.lit(True)), key, "full_outer")
    gap = F.abs(F.col("a") - F.col("b"))
    rel = safe_div(gap, F.abs(F.col("b")))
    return j.select(
        key, F.col("a").alias("value_a"), F.col("b").alias("value_b"),
        r8(gap).alias("abs_gap"), r8(rel).alias("rel_gap"),
        F.coalesce((gap == 0) | (rel <= F.lit(rel_tol)), F.lit(False)).alias("within_tol"),
        F.coalesce(F.col("_in_a"), F.lit(False)).alias("in_a"),
        F.coalesce(F.col("_in_b"), F.lit(False)).alias("in_b"),
    )


def rule(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """One rule as one aggregate row ``(rule, n_checked, n_bad)``."""
    return df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n_checked"),
                  F.count(F.when(bad, F.lit(1))).alias("n_bad"))


def duplicates(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once (identity checks)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.lit(name).alias("rule"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_checked"),
                 F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("n_bad"))


def dangling(df: DataFrame, name: str, key: str, ref: DataFrame, ref_key: str) -> DataFrame:
    """Rows whose key is absent from a reference table (pointer checks)."""
    r = ref.select(F.col(ref_key).alias("_ref"), F.lit(True).alias("_hit")).distinct()
    j = df.join(r, F.col(key) == F.col("_ref"), "left")
    return rule(j, name, F.col("_hit").isNull())


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All row rules of a table in one scan and one aggregate, as rows
    ``(rule, n_checked, n_bad)``; a rule is the condition of a bad row, and
    NULL counts as bad."""
    counts = [F.count(F.when(F.coalesce(bad, F.lit(True)), F.lit(1))).alias(f"b{i}") for i, bad in enumerate(rules.values())]
    g = df.agg(F.count(F.lit(1)).alias("n_checked"), *counts)
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"b{i}").alias("n_bad")) for i, name in enumerate(rules)])
    return g.select("n_checked", F.explode(each).alias("r")).select("r.rule", "n_checked", "r.n_bad")


def asymmetric_pointers(pointers: DataFrame) -> DataFrame:
    """Rows (source, target) without a row (target, source): a pointer that
    isn't answered.  One aggregation over unordered pairs; both directions of a
    pair combine in the tasks, so a target that many sources name stays cheap."""
    ends = [F.least("source", "target"), F.greatest("source", "target")]
    forth = F.col("source") <= F.col("target")
    g = pointers.filter("source is not null and target is not null").groupBy(ends[0].alias("_a"), ends[1].alias("_b")).agg(
        F.count(F.when(forth, 1)).alias("_forth"), F.count(F.when(~forth, 1)).alias("_back"))
    lone = g.filter("_a <> _b and (_forth = 0 or _back = 0)")
    answered = F.col("_forth") > 0
    return lone.select(F.when(answered, F.col("_a")).otherwise(F.col("_b")).alias("source"), F.when(answered, F.col("_b")).otherwise(F.col("_a")).alias("target"))


def run_checks(*rules: DataFrame) -> DataFrame:
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.select("rule", F.col("n_checked").cast("bigint").alias("n_checked"),
                      F.col("n_bad").cast("bigint").alias("n_bad"))


def staking_state(token_supply: DataFrame, asset: str, vault: str, unit: float) -> DataFrame:
    """Asset supply, the part staked in the vault, vault shares, staking ratio
    and share exchange rate from a token-supply snapshot (J-26)."""
    t = F.col("token")
    g = token_supply.filter(t.isin(asset, vault)).agg(
        F.sum(F.when(t == asset, F.col("total_supply"))).alias("sup"),
        F.sum(F.when(t == asset, F.col("vault_balance"))).alias("staked"),
        F.sum(F.when(t == vault, F.col("total_supply"))).alias("shares"),
    )
    sup, staked, shares = (F.col(c).cast("double") / F.lit(unit) for c in ("sup", "staked", "shares"))
    return g.select(
        sup.alias("asset_total_supply"), staked.alias("asset_staked"), shares.alias("vault_shares"),
        r8(safe_div(staked, sup)).alias("staking_ratio"), r8(safe_div(staked, shares)).alias("exchange_rate"),
    )


def param_table(row: DataFrame) -> DataFrame:
    """One wide parameter row -> ``(param, value)`` rows (J-29), via unpivot."""
    cols = [c for c in row.columns]
    r = row.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return r.unpivot([], cols, "param", "value")


def as_text(column: str, kind: str) -> Column:
    """A parameter as text, the same whatever engine reads it: whole numbers and
    text as they are, other numbers with eight places, times to the second."""
    c = F.col(column)
    if kind in ("float", "double") or kind.startswith("decimal"):
        return F.format_string("%.8f", c.cast("double"))
    if kind == "timestamp":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def setup_table(*parts: DataFrame) -> DataFrame:
    """Frames of at most one row each -> one ``(param, value)`` row per column,
    values as text (J-29).  Every parameter is listed: those of a frame without
    a row, like NULL values, have a NULL value."""
    out = None
    for part in parts:
        texts = part.agg(*[F.max(F.when(F.col(c).isNotNull(), as_text(c, kind))).alias(c) for c, kind in part.dtypes])
        rows = texts.unpivot([], part.columns, "param", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def transfers_self(transfers: DataFrame) -> Column:
    return (F.col("from") == F.col("to")) & (F.col("from") != F.lit(ZERO_ADDRESS))
