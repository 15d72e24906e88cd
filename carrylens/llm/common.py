"""Helpers shared by the operators of this subpackage: tables, the shared
folder, rolling hashes and connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carrylens.plans.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, the
    session helper sets one for a local master and refuses on a cluster."""
    return spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which cuts its lineage:
    a lost executor costs a re-read of the files, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- rolling hashes -------------------------------------------------------

# fixed values: constants of the murmur3 finalisers and two odd 64-bit multipliers
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values (murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 15)
            with np.errstate(over="ignore"):
                self.up = np.concatenate(([np.uint64(1)], np.full(size, _BASE, np.uint64))).cumprod(dtype=np.uint64)
                self.down = np.concatenate(([np.uint64(1)], np.full(size, _BASE_INV, np.uint64))).cumprod(dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


class RangeHash:
    """64-bit hashes of byte ranges of one buffer: prefix sums of
    ``value(byte) * base**i`` give each range in constant time."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data, dtype=np.uint8)
        up, self._down = _POWERS.upto(len(raw) + 1)
        self._sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[raw] * up[: len(raw)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix64(x + (ends - starts).astype(np.uint64))

    def fixed(self, length: int) -> np.ndarray:
        """Hashes of every range of ``length`` bytes, by start."""
        n = len(self._sums) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        x = (self._sums[length:] - self._sums[:n]) * self._down[:n]
        return mix64(x + np.uint64(length))


def window_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the index of its leftmost minimum
    (doubling over powers of two, as in a sparse table)."""
    n = len(h) - width + 1
    best = np.arange(len(h))
    span = 1
    while 2 * span <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(h[a] <= h[b], a, b)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(h[a] <= h[b], a, b)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the least values of all windows of ``width`` values (every
    place of a tie): those that equal the greatest minimum of their windows."""

    def sliding(x: np.ndarray, of, n: int) -> np.ndarray:
        span = 1
        while 2 * span <= n:
            x = of(x[: len(x) - span], x[span:])
            span *= 2
        return of(x[: len(x) - (n - span)], x[n - span :]) if n > span else x

    least = sliding(h, np.minimum, width)
    pad = np.zeros(width - 1, dtype=h.dtype)
    return np.flatnonzero(sliding(np.concatenate((pad, least, pad)), np.maximum, width) == h)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans as maximal runs, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# --- connected components -------------------------------------------------


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u, v), u > v.

    Large-star: an edge's smaller end becomes that end's own least neighbour.
    Small-star: a node keeps its least neighbour, and its others get that one.
    Three shuffles a round: what the driver keeps of a round goes with its tasks.
    A row makes one row at most, so repeats never add up; they go with the next
    round's ``distinct`` or meet as one row where a node has a single neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
    # dealt by the key of the join, so neither the repeats nor the join move them again
    once = edges.select("u", "v").repartition("v").distinct()
    large = once.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
    small = large.withColumn("m", F.min("v").over(Window.partitionBy("u"))).distinct()
    return small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (id, component_id), the smallest id reachable, for
    every id on an edge.

    Alternating large-star and small-star steps (logarithmically many rounds);
    each round is a written table, so nothing is gathered on the driver but a
    count and a checksum that show when the edges stop changing.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == last or sums[0] == 0:
            break
        last = tuple(sums)
        now = written(_stars(now), "links")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
