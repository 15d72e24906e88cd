"""Global ranking and running sums without a single-partition window (R2).

``row_number() OVER (ORDER BY x)`` and an un-partitioned running ``SUM`` make
Spark move every row into one task (``Exchange SinglePartition``).  Two exact
replacements:

* :func:`top_k_with_running` — when only the first k rows are reported, take
  them with ``orderBy().limit(k)`` (``TakeOrderedAndProject``: a bounded
  per-partition top-k, merged in one task of k x partitions rows) and run the
  window over those k rows only.  Totals come from a global aggregate, a
  one-row side.
* :func:`global_rank` — when every row needs its rank: range-partition on the
  full (tie-broken) order key, checkpoint so partition ids stay stable when a
  lost executor forces a recompute, count/sum each partition, turn those into
  prefix offsets over the *partition* table (one row per partition, a bounded
  broadcast) and finish with a per-partition window plus offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    running: Mapping[str, Column] | None = None,
    rank_col: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add a 1-based BIGINT ``rank_col`` in ``order`` and, for each
    ``name -> expr`` in ``running``, ``SUM(expr) ROWS BETWEEN UNBOUNDED
    PRECEDING AND CURRENT ROW`` in that order.  ``order`` must be a total
    order (end it with a unique key) so ranks are deterministic."""
    running = dict(running or {})
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tmp = {f"_rv{i}": e for i, e in enumerate(running.values())}
    base = df.select("*", *[e.alias(k) for k, e in tmp.items()])
    ranged = base.repartitionByRange(n, *order).checkpoint(eager=True)
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    stats = ranged.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("_cnt"), *[F.sum(k).alias(f"{k}_tot") for k in tmp])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        *[F.sum(f"{k}_tot").over(before).alias(f"{k}_off") for k in tmp],
    )
    # one row per partition: a bounded side, broadcast explicitly
    j = ranged.join(F.broadcast(offsets), "_pid")
    local = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [c for c in df.columns]
    out = j.select(
        *cols,
        (F.row_number().over(local) + F.col("_off")).cast("bigint").alias(rank_col),
        *[
            (F.sum(k).over(local) + F.coalesce(F.col(f"{k}_off"), F.lit(0))).alias(name)
            for (name, _), k in zip(running.items(), tmp)
        ],
    )
    return out


def top_k_with_running(
    df: DataFrame,
    order: Sequence[Column],
    k: int,
    running: Mapping[str, Column] | None = None,
    rank_col: str = "rank",
) -> DataFrame:
    """The first ``k`` rows of ``order`` with rank and running sums, exact:
    the cumulative order equals the limit order, so a running sum over the
    top k equals the global running sum at those rows."""
    running = dict(running or {})
    top = df.orderBy(*order).limit(k)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return top.select(
        "*",
        F.row_number().over(w).cast("bigint").alias(rank_col),
        *[F.sum(e).over(w).alias(name) for name, e in running.items()],
    )


def exact_median(df: DataFrame, value: str, tiebreak: str) -> DataFrame:
    """Exact median of ``value`` (mean of the middle pair when the count is
    even) as a one-row DataFrame, without gathering the values of the group
    into one task: the built-in exact ``percentile``/``median`` buffers every
    value of a group in a single aggregation buffer, which does not bound at
    scale.  Here the values are globally ranked (range partitioned, see
    :func:`global_rank`) and only the one or two middle ranks are kept."""
    v = df.filter(F.col(value).isNotNull()).select(value, tiebreak)
    n = v.agg(F.count(F.lit(1)).alias("_n"))
    ranked = global_rank(v, [F.col(value).asc(), F.col(tiebreak).asc()], rank_col="_r")
    lo = F.floor((F.col("_n") + 1) / 2)
    hi = F.floor(F.col("_n") / 2) + 1
    mid = ranked.crossJoin(F.broadcast(n)).filter((F.col("_r") == lo) | (F.col("_r") == hi))
    return mid.agg(F.avg(value).alias("median"))
