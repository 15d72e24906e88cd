"""Near-duplicate documents by circulant MinHash.

A document's set holds the 64-bit hashes of its distinct word shingles.  Two
permutations make the whole signature: the first (sigma) scatters a shingle
over 32-bit places, the second (pi) ranks the places, and coordinate k is the
least rank after a circular shift by k, ``min pi((sigma(x) + k) mod 2**32)``.
Bands of coordinates give candidate buckets; every link is confirmed by the
exact Jaccard similarity of the full sets.

Scale: equal sets are one class first, so exact copies never meet in pairs.
Within a bucket only (least member, other member) is compared; afterwards only
members of *different* components in a bucket are, so a big group of near
copies costs a link per member.  Buckets that still hold many components are
compared in salted blocks, the members outside the largest component against
all: no pair is left out.  The
leader's members are dealt in salted portions.  The later pairs pass an exact
bound first: with S(x) the shingles of x that any other candidate holds,
``J(a, b) <= m / (|a| + |b| - m)`` for ``m = min(S(a), S(b))``.  They also
carry 1024 more coordinates, a bit of each, which the join itself compares, so
members of a big family that stay under the threshold make no rows.

Edge cases: null or wordless texts have the empty set, no links, and are their
own component; fewer words than a shingle make one shingle of all words; rows
with one doc_id are one node, linked if any of its rows is; a null doc_id has
no links and a null component_id (kept is true); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrylens.llm.common import RangeHash, components, mix64, table, written

SHINGLE = 5
BANDS, ROWS = 40, 4  # a pair at 0.75 shares no band with probability (1 - 0.75**4)**40 < 3e-7
PERCENT = 75
SKETCH_MIN = 0.58  # share of equal coordinates below which a candidate isn't compared (five deviations under 0.75)
SPLIT = 4096  # members above which a bucket of several components is compared in blocks of this size
BITS = 1024  # coordinates whose lowest bit is compared before a later pair is made
UNLIKE = 179  # bits that may differ: a similarity of 0.65, five deviations under 0.75
PORTION = 2000  # members compared with one copy of their leader


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    data = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = min(size, len(words))
    return np.unique(RangeHash(data).of(starts[: len(words) - n + 1], ends[n - 1 :]))


def signature(values: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: one permutation, ``n`` circular shifts."""
    places = (values >> np.uint64(32)).astype(np.uint32)  # sigma: the hash is mixed already
    shifts = np.arange(n, dtype=np.uint32)[:, None]
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(places), 512):
        x = places[None, i : i + 512] + shifts
        x ^= x >> np.uint32(16)  # pi: the 32-bit murmur3 finaliser
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key ^ rows[:, r] * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


_SIGNED = "doc_id bigint, n_shingles bigint, set_id binary, sketch binary, bands array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, ids, sketches, bands = [], [], [], []
        for text in b.column("text").to_pylist():
            values = shingles(text)
            n.append(len(values))
            if len(values):
                sig = signature(values)
                ids.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                sketches.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
                bands.append(band_keys(sig))
            else:
                ids.append(None)
                sketches.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "sketch", "bands"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps candidates whose sketches (a byte of each coordinate) agree enough."""
    for b in batches:
        left, right = b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist()
        keep = [np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) >= SKETCH_MIN * len(x) for x, y in zip(left, right)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leader, portion, role): a leader's rows (role 0), then
    the documents to compare with it.  One leader's set is held at a time."""
    key, leaders = None, []
    for b in batches:
        out_a, out_b = [], []
        for leader, portion, role, doc, text in zip(*(b.column(c).to_pylist() for c in ("a", "portion", "role", "doc_id", "text"))):
            if (leader, portion) != key:
                key, leaders = (leader, portion), []
            values = shingles(text)
            if role == 0:
                leaders.append(values)
                continue
            for other in leaders:
                small = min(len(values), len(other))
                if 100 * small < PERCENT * max(len(values), len(other)):
                    continue
                both = len(np.intersect1d(values, other, assume_unique=True))
                if 100 * both >= PERCENT * (len(values) + len(other) - both):
                    out_a.append(leader)
                    out_b.append(doc)
                    break
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) whose sizes and sketches allow a link."""
    sizes = signed.select("doc_id", "n_shingles", "sketch").filter("sketch is not null")
    left = sizes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sketch_a"))
    right = sizes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sketch_b"))
    return (pairs.join(left, "a").join(right, "b")
            .filter(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
            .select("a", "b", "sketch_a", "sketch_b").mapInArrow(_alike, "a bigint, b bigint").distinct())


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) -> the pairs whose full sets reach the threshold."""
    near = written(pairs.withColumn("portion", F.pmod(F.xxhash64("b"), F.lit(1 << 20))), "near")
    portions = near.groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PORTION)).alias("portions"))
    members = near.join(portions, "a").select("a", F.expr("portion % portions").alias("portion"), F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    leaders = portions.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("portions") - 1)).alias("portion"), F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    rows = members.union(leaders).join(docs.select("doc_id", "text"), "doc_id").select("a", "portion", "role", "doc_id", "text")
    rows = rows.repartition("a", "portion").sortWithinPartitions("a", "portion", "role", "doc_id")
    return rows.mapInArrow(_verify, "a bigint, b bigint").distinct()


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            values = shingles(text)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), doc), pa.int64()), pa.array(values.view(np.int64))], ["doc_id", "shingle"])


def _held(docs: DataFrame) -> DataFrame:
    """(doc_id, held): how many shingles of a document another of ``docs`` holds."""
    sets = docs.mapInArrow(_explode, "doc_id bigint, shingle bigint")
    common = sets.groupBy("shingle").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("shingle")
    return sets.join(common, "shingle", "left_semi").groupBy("doc_id").agg(F.count("*").alias("held"))


def _mixed(rows: DataFrame, component: DataFrame) -> DataFrame:
    """(key, doc_id, component_id, n) of the buckets that hold several components."""
    rows = (rows.select("key", "doc_id").join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .select("key", "doc_id", F.coalesce("component_id", "doc_id").alias("component_id")))
    several = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).filter("lo < hi")
    return written(rows.join(several.select("key", "n"), "key"), "mixed")


_WORDS = [f"w{i}" for i in range(BITS // 64)]


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, w0, w1, ...): the lowest bits of BITS coordinates."""
    for b in batches:
        packed = [np.packbits((signature(shingles(t), BITS) & 1).astype(np.uint8)).view(np.int64) for t in b.column("text").to_pylist()]
        cols = np.array(packed, dtype=np.int64).reshape(len(packed), len(_WORDS)).T
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in cols)], ["doc_id", *_WORDS])


def _bound(a: str, b: str):
    """Whether two sets can reach the threshold, from sizes (sa, sb) and held counts (ha, hb)."""
    most = F.least(f"h{a}", f"h{b}")
    return 100 * most >= PERCENT * (F.col(f"s{a}") + F.col(f"s{b}") - most)


def _cross(mixed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of members of different components that share a bucket and pass
    the bounds, each made in the first of its common buckets.

    In a bucket of over SPLIT members the pairs are those of a minor member
    (outside the bucket's largest component) with any other, tried in blocks: a
    member stands in one block of about SPLIT, and the minor ones are copied to
    all blocks.  Nothing is left out, and the largest component's members are
    never held against each other."""
    rows = mixed.join(sizes, "doc_id")
    unlike = F.expr(" + ".join(f"bit_count({w}a ^ {w}b)" for w in _WORDS) + f" <= {UNLIKE}")
    alike = F.expr("ca <> cb") & _bound("a", "b") & unlike & (F.array_min(F.array_intersect("ba", "bb")) == F.col("l.key"))

    def side(df: DataFrame, x: str, *more: str) -> DataFrame:
        return df.select("key", *more, *(F.col(c).alias(c[0] + x) for c in ("doc_id", "component_id", "s", "h", "bands")), *(F.col(w).alias(w + x) for w in _WORDS))

    few = rows.filter(f"n <= {SPLIT}")
    pairs = side(few, "a").alias("l").join(side(few, "b").alias("r"), (F.col("l.key") == F.col("r.key")) & F.expr("da < db") & alike)
    found = pairs.select(F.col("da").alias("a"), F.col("db").alias("b"))
    if mixed.filter(f"n > {SPLIT}").isEmpty():
        return found.distinct()
    many = rows.filter(f"n > {SPLIT}").withColumn("blocks", F.ceil(F.col("n") / SPLIT).cast("int"))
    parts = many.groupBy("key", "component_id").agg(F.count("*").alias("held"))
    major = parts.groupBy("key").agg(F.max(F.struct("held", F.col("component_id").alias("major")))["major"].alias("major"))
    many = many.join(major, "key").withColumn("minor", F.col("component_id") != F.col("major"))
    left = many.filter("minor").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = many.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    when = (F.col("l.key") == F.col("r.key")) & (F.col("l.block") == F.col("r.block")) & F.expr("not minor or da < db") & alike
    pairs = side(left, "a", "block").alias("l").join(side(right, "b", "block", "minor").alias("r"), when)
    return found.union(pairs.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"))).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    signed = written(docs.mapInArrow(_sign, _SIGNED), "signed")
    full = signed.filter("set_id is not null and doc_id is not null")
    classes = written(full.groupBy("set_id").agg(F.min("doc_id").alias("class_id")), "classes")
    reps = full.join(classes, "set_id").filter("doc_id = class_id").select("doc_id", "bands")
    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    leaders = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).filter("a < last").select("key", "a")
    members = written(rows.join(leaders, "key"), "buckets")
    texts = written(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    stars = members.filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    links = written(confirm(likely(stars, signed), texts), "links")
    near = components(links)
    mixed = _mixed(members, near)
    candidates = texts.join(mixed.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = signed.join(_held(candidates), "doc_id").filter(f"100 * held >= {PERCENT} * n_shingles").select("doc_id", F.col("n_shingles").alias("s"), F.col("held").alias("h"), "bands")
    sizes = written(sizes, "held")
    bits = texts.join(sizes.select("doc_id"), "doc_id", "left_semi").mapInArrow(_bits, "doc_id bigint, " + ", ".join(f"{w} bigint" for w in _WORDS))
    sizes = written(sizes.join(bits, "doc_id"), "bits")
    cross = _cross(mixed, sizes)
    cross = written(cross.join(stars, ["a", "b"], "left_anti"), "cross")
    # the components found so far stand for their links: each member's edge to the smallest
    links = near.filter("id <> component_id").select(F.col("component_id").alias("a"), F.col("id").alias("b"))
    if not cross.isEmpty():
        links = links.union(confirm(cross, texts))
    # equal sets are links too; they also tie the sets of rows that share a doc_id
    copies = full.join(classes, "set_id").filter("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    nodes = components(links.union(copies)).withColumnRenamed("id", "doc_id")
    out = signed.select("doc_id", "n_shingles").join(nodes, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
