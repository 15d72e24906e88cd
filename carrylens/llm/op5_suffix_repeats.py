"""Repeated byte strings by common-prefix intervals of sparse suffix arrays.

Suffixes are taken at content-chosen places (of every 50-byte window the
16-byte gram with the least hash), so two equal windows hold equal places.
Documents that share a place's gram send its surroundings to one shard, which
builds an enhanced suffix array of them (suffixes in order, longest common
prefixes), stack-scans it into common-prefix intervals, and tests the left
extensions of an interval's occurrences in the same way: a group that agrees
to the left as far as it can and to the right as far as it can is a maximal
repeat, with all its occurrences.  Every group of at least 50 bytes marks its
occurrences whose doc_id is not the smallest.

Scale: exact copies are recognised by digest first.  Grams held by one
document only are dropped by a count over one shuffle that spills.  A
shard's tasks hold whole grams of a bounded number of occurrences; a gram with
more than ``HOT`` occurrences is settled window by window in a plain
aggregation (the same windows, keyed by content), so no group is gathered.

Edge cases: null or empty texts have no bytes; texts under 50 bytes lose
nothing; rows with one doc_id never remove from each other; a null doc_id
neither removes nor is removed from; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carrylens.llm.common import RangeHash, merge_spans, table, window_minima, written

WINDOW = 50
GRAM = 16
REACH = WINDOW - GRAM  # bytes to the left of a gram that a window can hold
HOT = 50_000  # occurrences of a gram above which its windows are settled one by one
BROADCAST_ROWS = 2_000_000  # copies (16 bytes each) up to which they go to every task; more are joined by a shuffle
CHUNK = 20_000  # suffixes of one array at most, besides one gram


def places_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Chosen places of a text and the hashes of their grams."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = RangeHash(data).fixed(GRAM)
    at = window_minima(grams, REACH + 1)
    return at, grams[at].view(np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_ROWS = "doc_id bigint, row_id bigint, n_bytes bigint, digest binary"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [_bytes(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_id"), pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in data], pa.binary())], ["doc_id", "row_id", "n_bytes", "digest"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc_id, row_id, n): the grams of each document and how often it has them."""
    for b in batches:
        grams, counts, sizes = [], [], []
        for text in b.column("text"):
            g, n = np.unique(places_of(_bytes(text.as_py()))[1], return_counts=True)
            grams.append(g)
            counts.append(n)
            sizes.append(len(g))
        ids = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("doc_id", "row_id"))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams or [np.zeros(0, np.int64)])), *(pa.array(x) for x in ids), pa.array(np.concatenate(counts or [np.zeros(0, np.int64)]))], ["gram", "doc_id", "row_id", "n"])


_SUFFIXES = "gram bigint, doc_id bigint, row_id bigint, at bigint, before binary, after binary"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row_id, text, shared) -> every place of a shared gram with
    the bytes before it (nearest first) and from it on."""

    def flush() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["gram", "doc_id", "row_id", "at", "before", "after"])

    cols: list[list] = [[] for _ in range(6)]
    for b in batches:
        for doc, row, text, shared in zip(b.column("doc_id").to_pylist(), b.column("row_id").to_pylist(), b.column("text"), b.column("shared")):
            data = _bytes(text.as_py())
            at, grams = places_of(data)
            keep = np.isin(grams, shared.values.to_numpy())
            at, grams = at[keep].tolist(), grams[keep].tolist()
            for col, v in zip(cols, (grams, [doc] * len(at), [row] * len(at), at, [data[max(0, p - REACH) : p][::-1] for p in at], [data[p : p + WINDOW] for p in at])):
                col += v
            if len(cols[0]) >= CHUNK:
                yield flush()
                cols = [[] for _ in range(6)]
    if cols[0]:
        yield flush()


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of byte values + 1, zero from their end on."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    return np.where(np.arange(width) < lengths[:, None], flat.astype(np.uint16) + 1, 0)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows; an end equals nothing."""
    same = (a == b) & (a > 0)
    return np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))


def _order(m: np.ndarray) -> np.ndarray:
    """Lexicographic order of rows."""
    wide = np.zeros((len(m), -(-m.shape[1] // 4) * 4), np.uint64)
    wide[:, : m.shape[1]] = m
    words = (wide[:, 0::4] << np.uint64(48)) | (wide[:, 1::4] << np.uint64(32)) | (wide[:, 2::4] << np.uint64(16)) | wide[:, 3::4]
    return np.lexsort(words.T[::-1])


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan of an LCP array (``common[i]`` for suffixes i, i + 1): the
    common-prefix intervals (length, first, last) of at least ``least``."""
    stack: list[tuple[int, int]] = []  # (length, first)
    for i, c in enumerate([*common, 0]):
        first = i
        while stack and stack[-1][0] > c:
            length, first = stack.pop()
            yield length, first, i
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append((c, first))


def maximal_repeats(before: list[bytes], after: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Suffixes with the bytes before them (nearest first) -> groups (left, right,
    members): members agree on exactly ``left`` bytes before and ``right`` bytes
    from their place, WINDOW together at least."""
    left, right = _matrix(before, REACH), _matrix(after, WINDOW)
    suffixes = _order(right)
    right = right[suffixes]
    common = _common(right[:-1], right[1:]).tolist()
    rank = np.empty(len(suffixes), np.int64)
    rank[_order(left)] = np.arange(len(suffixes))
    for length, lo, hi in intervals(common, GRAM):
        members = suffixes[lo : hi + 1]
        need = WINDOW - length
        if len(members) == 2:
            a, b = members
            same = (left[a] == left[b]) & (left[a] > 0)
            agree = REACH if same.all() else int(np.argmin(same))
            if agree >= need:
                yield agree, length, members
            continue
        members = members[np.argsort(rank[members])]
        agree = _common(left[members[:-1]], left[members[1:]])
        if need <= 0:
            yield 0, length, members
        if agree.max() < max(need, 1):
            continue
        for n, first, last in intervals(agree.tolist(), max(need, 1)):
            yield n, length, members[first : last + 1]


_MARKED = "doc_id bigint, row_id bigint, first bigint, last bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram: whole grams are collected up to CHUNK suffixes.  The
    marks of one occurrence all hold its place, so they join to one span."""

    def flush(cols: list[list]) -> pa.RecordBatch:
        docs, rows, ats, before, after = cols
        # equal surroundings are one suffix, of the smallest doc_id that has them
        kinds: dict[tuple[bytes, bytes], int] = {}
        kind = np.fromiter((kinds.setdefault(x, len(kinds)) for x in zip(before, after)), np.int64, len(docs))
        doc = np.array(docs, np.int64)
        least = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, doc)
        l, r = [b for b, _ in kinds], [a for _, a in kinds]
        whole = np.array([len(x) + len(y) >= WINDOW for x, y in kinds], dtype=bool)
        reach_l, reach_r = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        for n, length, members in maximal_repeats(l, r) if len(kinds) > 1 else ():
            late = members[least[members] > least[members].min()]
            reach_l[late] = np.maximum(reach_l[late], n)
            reach_r[late] = np.maximum(reach_r[late], length)
        # occurrences of a kind that aren't its first lose all of it; others what the kind shares with smaller doc_ids
        copy = (doc > least[kind]) & whole[kind]
        ends_l, ends_r = np.array([len(x) for x in l])[kind], np.array([len(x) for x in r])[kind]
        lose_l, lose_r = np.where(copy, ends_l, reach_l[kind]), np.where(copy, ends_r, reach_r[kind])
        at, hit = np.array(ats, np.int64), lose_r > 0
        return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(np.array(rows, np.int64)[hit]), pa.array((at - lose_l)[hit]), pa.array((at + lose_r)[hit])], ["doc_id", "row_id", "first", "last"])

    held: list[list] = [[] for _ in range(5)]
    for b in batches:
        new = [c.to_pylist() for c in b.columns]
        gram = [a[:GRAM] for a in new[4]]
        start = 0
        while len(held[0]) + len(new[0]) - start >= CHUNK:
            # up to the first change of gram at or after CHUNK
            i = max(start + CHUNK - len(held[0]), start + (0 if held[0] else 1))
            last = lambda k: gram[k - 1] if k > start else held[4][-1][:GRAM]
            while i < len(new[0]) and gram[i] == last(i):
                i += 1
            if i >= len(new[0]):
                break
            yield flush([h + n[start:i] for h, n in zip(held, new)])
            held, start = [[] for _ in range(5)], i
        held = [h + n[start:] for h, n in zip(held, new)]
    if held[0]:
        yield flush(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different windows around a document's places, with where each starts."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    for b in batches:
        starts: dict[tuple[int, int, int], set[int]] = {}
        for doc, row, at, before, after in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row_id", "at", "before", "after"))):
            first = at - len(before)
            for k, h in enumerate(RangeHash(before[::-1] + after).fixed(WINDOW).view(np.int64).tolist()):
                starts.setdefault((doc, row, h), set()).add(first + k)
        cols = (*zip(*starts), [sorted(x) for x in starts.values()]) if starts else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "row_id", "window", "starts"])


def _by_gram(suffixes: DataFrame) -> DataFrame:
    """Suffixes dealt by their first bytes, the gram, and in its order."""
    bare = suffixes.select("doc_id", "row_id", "at", "before", "after")
    return bare.repartition(F.substring("after", 1, GRAM)).sortWithinPartitions("after")


def repeat_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents (doc_id, row_id, text) -> (copies, spans, starts): rows all of
    whose bytes a smaller doc_id has as a whole text, the byte spans (first, last)
    of the other rows that a smaller doc_id has too, and where windows of the hot
    grams start (an array a row) that a smaller doc_id has."""
    rows = written(docs.mapInArrow(_digest, _ROWS).filter(f"n_bytes >= {WINDOW} and doc_id is not null"), "rows")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    judged = written(rows.join(least, "digest").select("doc_id", "row_id", (F.col("doc_id") > F.col("least")).alias("copy")).distinct(), "judged")
    copies = written(judged.filter("copy").select("doc_id", "row_id"), "copies")
    few = copies.count() <= BROADCAST_ROWS
    grams = docs.filter("doc_id is not null").mapInArrow(_grams, "gram bigint, doc_id bigint, row_id bigint, n bigint")
    grams = grams.join(F.broadcast(copies) if few else copies, ["doc_id", "row_id"], "left_anti").select("gram", "doc_id", "n")
    # one shuffle: a gram's documents are counted next to each other, spilling where they are many
    held = F.count("*").over(W.partitionBy("gram"))
    hits = written(grams.withColumn("held", held).filter("held > 1").select("gram", "doc_id", "n"), "hits")
    hot = written(hits.groupBy("gram").agg(F.sum("n").alias("n")).filter(f"n > {HOT}").select("gram"), "hot")
    # each (document, gram) is one row, so nothing combines before the shuffle
    shared = hits.repartition("doc_id").groupBy("doc_id").agg(F.collect_list("gram").alias("shared"))
    texts = docs.join(F.broadcast(copies) if few else copies, ["doc_id", "row_id"], "left_anti").join(shared, "doc_id")
    suffixes = texts.select("doc_id", "row_id", "text", "shared").mapInArrow(_suffixes, _SUFFIXES)
    if hot.isEmpty():
        spans = _by_gram(suffixes).mapInArrow(_scan, _MARKED)
        return copies, written(spans, "marked"), docs.sparkSession.createDataFrame([], "doc_id bigint, row_id bigint, starts array<bigint>")
    suffixes = written(suffixes, "suffixes")
    spans = _by_gram(suffixes.join(hot, "gram", "left_anti")).mapInArrow(_scan, _MARKED)
    windows = written(suffixes.join(hot, "gram").mapInArrow(_windows, "doc_id bigint, row_id bigint, window bigint, starts array<bigint>"), "windows")
    first = windows.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    late = windows.join(first, "window").filter("doc_id > lo").select("doc_id", "row_id", "starts")
    return copies, written(spans, "marked"), late


_KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(4)]
        for text, spans, starts, copy in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "starts", "copy"))):
            data = _bytes(text)
            runs = [(0, len(data))] if copy else merge_spans([(s["first"], s["last"]) for s in spans or ()] + [(a, a + WINDOW) for a in starts or ()])
            keep, last = [], 0
            for a, z in runs:
                keep.append(data[last:a])
                last = z
            keep.append(data[last:])
            for col, v in zip(out, (len(data), sum(z - a for a, z in runs), len(runs), b"".join(keep))):
                col.append(v)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_id"))
    copies, spans, starts = repeat_spans(docs)
    spans = spans.groupBy("doc_id", "row_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    starts = starts.groupBy("doc_id", "row_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    marks = spans.join(starts, ["doc_id", "row_id"], "full").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "row_id"], "full")
    return docs.join(marks, ["doc_id", "row_id"], "left").select("doc_id", "text", "spans", "starts", "copy").mapInArrow(_cut, _KEPT)


def op5_common_prefix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
