"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

A fingerprint holds 64 majority bits of a text's shingle hashes.  Two
fingerprints within ``radius`` bits have a middle within half of it of both,
so every fingerprint emits all its variants within half the radius, the
variants are shuffled, and fingerprints that meet on a variant are candidate
pairs, made once each and verified by their differing bits.

Scale: rows of one fingerprint are one class first, so copies cost one row
between them and a hot fingerprint (the wordless texts', say) emits its ball
once.  A variant is met by its own ball at most (65 fingerprints at radius 2),
whatever the corpus; within it neighbours in sorted order are linked, not all
pairs: members of a ball lie within the whole radius of each other, so the
chain connects just what the pairs would.

Edge cases: null or wordless texts have fingerprint zero, which links like any
other; fewer words than a shingle make one shingle of all words; rows with one
doc_id are one node, linked if any of its rows is; a null doc_id links nothing
and has a null component_id; an empty table gives no rows; whole texts count,
at any length (hashes are counted in blocks); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carrylens.llm.common import components, table, written

SHINGLE = 3
SEED = 42
RADIUS = 2
_BLOCK = 1 << 16  # hashes counted at a time

#: The bits of each byte value, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included, as a signed 64-bit value."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    data = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - size + 1)
    starts, stops = (ends - lengths)[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    of, counts = xxhash.xxh64_intdigest, np.zeros((8, 8), dtype=np.int64)
    for k in range(0, n, _BLOCK):
        hashes = np.array([of(data[a:z], SEED) for a, z in zip(starts[k : k + _BLOCK], stops[k : k + _BLOCK])], dtype=">u8")
        places = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts += np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * counts > n).ravel()).view(">i8")[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = [fingerprint(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])


def masks(bits: int) -> list[int]:
    """Every 64-bit mask of at most ``bits`` ones, as signed values."""
    found = [sum(1 << k for k in ones) for n in range(bits + 1) for ones in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links (fp_a, fp_b) between fingerprints
    that differ in at most ``radius`` bits.  They connect all such fingerprints;
    of the members of one ball only neighbours in order are listed."""
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: at an odd one the members of a ball needn't be alike")
    ball = F.array(*map(F.lit, masks(radius // 2)))
    variants = prints.select("fp", F.explode(ball).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.select(F.lag("fp").over(W.partitionBy("variant").orderBy("fp")).alias("fp_a"), F.col("fp").alias("fp_b"))
    pairs = met.filter("fp_a is not null").distinct()
    return pairs.filter(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """documents (doc_id, text) -> doc_id, fp (signed 64 bits), component_id: one row per document."""
    signed = written(docs.select("doc_id", "text").mapInArrow(_sign, "doc_id bigint, fp bigint"), "prints")
    known = signed.filter("doc_id is not null")
    classes = written(known.groupBy("fp").agg(F.min("doc_id").alias("class_id")), "classes")
    names = (classes.select(F.col("fp").alias(f"fp_{x}"), F.col("class_id").alias(x)) for x in "ab")
    links = ball_links(classes.select("fp"), radius)
    for side in names:
        links = links.join(side, side.columns[0])
    # the classes of a doc_id with several texts belong together
    several = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("doc_id")
    held = known.join(several, "doc_id").distinct().join(classes, "fp").select("doc_id", "class_id")
    tied = held.join(held.groupBy("doc_id").agg(F.min("class_id").alias("a")), "doc_id").select("a", F.col("class_id").alias("b"))
    nodes = components(links.select("a", "b").union(tied)).withColumnRenamed("id", "class_id")
    named = classes.join(nodes, "class_id", "left").select("fp", F.coalesce("component_id", "class_id").alias("found"))
    return signed.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("found")).alias("component_id"))


def op12_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
