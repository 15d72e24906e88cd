"""Exact ranks, running sums and medians by bands of the order axis.

Borders are rows of a bounded sample (``SAMPLES`` a band, chosen by a hash of
the row), so bands hold about equally many rows; with a unique last key no
value can overfill one.  A row's band is a literal decision over the borders,
so the rows move once, by band: ranks and running sums are a window within
the band plus what the earlier bands hold, which is one row per band.  A
median counts bands and orders only the one or two that hold the middle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cmp_to_key

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import materialize

SAMPLES = 32
Key = tuple[str, bool]  # column, ascending; a NULL comes last


def _order(keys: Sequence[Key]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys]


def _compare(keys: Sequence[Key]):
    def compare(a, b) -> int:
        for x, y, (_, up) in zip(a, b, keys):
            if x != y:
                if x is None or y is None:
                    return 1 if x is None else -1
                return (-1 if x < y else 1) * (1 if up else -1)
        return 0

    return compare


def borders(df: DataFrame, keys: Sequence[Key], bands: int) -> list[tuple]:
    """``bands - 1`` rows of keys that cut ``df`` into about equal bands."""
    cols = [c for c, _ in keys]
    sample = [tuple(r) for r in df.select(*cols).orderBy(F.xxhash64(*cols), *_order(keys)).limit(SAMPLES * bands).collect()]
    compare = _compare(keys)
    sample.sort(key=cmp_to_key(compare))
    cut: list[tuple] = []
    for k in range(1, bands):
        row = sample[len(sample) * k // bands] if sample else None
        if row is not None and (not cut or compare(cut[-1], row) < 0):
            cut.append(row)
    return cut


def _before(row: tuple, keys: Sequence[Key], schema) -> Column:
    """Whether a row comes before this border: lexicographic, NULL last."""
    out = F.lit(False)
    for value, (c, up) in reversed(list(zip(row, keys))):
        if value is None:
            out = F.col(c).isNotNull() | out
            continue
        border = F.lit(value).cast(schema[c].dataType)
        less = F.col(c) < border if up else F.col(c) > border
        out = F.coalesce(less | ((F.col(c) == border) & out), F.lit(False))
    return out


def band_of(cut: Sequence[tuple], keys: Sequence[Key], schema) -> Column:
    """A row's band by halving the borders: about log2(bands) comparisons a row."""
    def halve(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_before(cut[mid], keys, schema), halve(lo, mid)).otherwise(halve(mid + 1, hi))

    return halve(0, len(cut))


def banded_rank(df: DataFrame, keys: Sequence[Key], running: Mapping[str, Column] | None = None, rank_col: str = "rank", bands: int | None = None) -> DataFrame:
    """``df`` with its 1-based rank by ``keys`` (a total order) and for each
    name of ``running`` the sum of its values up to and with the row.  ``df``
    is read for the sample and for the table that is written by band; it should
    hold only the columns that are used."""
    running = dict(running or {})
    bands = bands or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = borders(df, keys, bands)
    x = df.select("*", band_of(cut, keys, df.schema).alias("_band"), *[e.alias(f"_v_{n}") for n, e in running.items()])
    local = Window.partitionBy("_band").orderBy(*_order(keys)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = x.select(*df.columns, "_band", F.row_number().over(local).cast("bigint").alias("_place"), *[F.sum(f"_v_{n}").over(local).alias(f"_upto_{n}") for n in running])
    placed = materialize(placed)
    # the last row of a band has its count and sums; a sum is NULL until the first value
    ends = placed.groupBy("_band").agg(F.max("_place").alias("_n"), *[F.max_by(f"_upto_{n}", "_place").alias(f"_all_{n}") for n in running])
    earlier = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("_band", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), *[F.sum(f"_all_{n}").over(earlier).alias(f"_all_{n}") for n in running])
    # one row per band, at most ``bands``
    j = placed.join(F.broadcast(offsets), "_band")
    zero = F.lit(0)
    sums = [F.when(F.col(f"_upto_{n}").isNotNull() | F.col(f"_all_{n}").isNotNull(), F.coalesce(f"_upto_{n}", zero) + F.coalesce(f"_all_{n}", zero)).alias(n) for n in running]
    return j.select(*df.columns, (F.col("_place") + F.col("_n")).cast("bigint").alias(rank_col), *sums)


def banded_median(df: DataFrame, value: str, unique: str, bands: int | None = None) -> DataFrame:
    """The exact median (mean of the middle pair) as one row ``median``; NULL
    for no values.  Bands are counted by a partial aggregation; only rows of
    the bands with the middle places are ordered, there is no global sort."""
    keys = [(value, True), (unique, True)]
    v = materialize(df.filter(F.col(value).isNotNull()).select(value, unique))  # read for borders, counts and the middle
    bands = bands or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    banded = v.withColumn("_band", band_of(borders(v, keys, bands), keys, v.schema))
    sizes = sorted((r[0], r[1]) for r in banded.groupBy("_band").count().collect())  # at most ``bands`` rows
    total, seen, wanted = sum(n for _, n in sizes), 0, []
    for place in sorted({(total + 1) // 2, total // 2 + 1}) if total else []:
        seen = 0
        for band, n in sizes:
            if seen < place <= seen + n:
                wanted.append((band, place - seen))
            seen += n
    rows = banded.filter(F.col("_band").isin([b for b, _ in wanted]))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_band").orderBy(*_order(keys))))
    middle = F.lit(False)
    for band, place in wanted:
        middle = middle | ((F.col("_band") == band) & (F.col("_place") == place))
    return rows.filter(middle).agg(F.avg(value).alias("median"))
