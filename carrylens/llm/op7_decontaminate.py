"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents of one task.  Its words are symbols; the
index is the Burrows-Wheeler transform of their suffix array with a wavelet
matrix for ranks and sampled suffix positions.  Test phrases (windows of
consecutive item words) are searched backwards, all at once, and every
occurrence is located by walking to a sampled position.  Overlapping
occurrences merge into removal spans.

A word that no phrase holds can be in no occurrence, so the index keeps the
runs of phrase words that are at least as long as the shortest phrase,
separated by a symbol that no phrase has.

Scale: documents are read once and not shuffled.  The phrases go to the tasks
in blocks of at most ``BLOCK_BYTES`` of item text, one pass per block, so what
is broadcast is bounded however large the benchmark is.

Edge cases: null texts have no words; items without words or with a null
item_id have no phrase; equal items are all reported, an item_id once
however many rows it has; an empty benchmark finds
nothing; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrylens.llm.common import merge_spans, table

WINDOW = 10
SAMPLE = 16  # every so many text positions keep their suffix's place
SHARD = 1 << 18  # indexed symbols of a shard at most, besides one document
SHARD_DOCS = 20_000
BLOCK_BYTES = 8 << 20

# word bytes are digits, a-z and everything above ASCII; A-Z is lower-cased
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class FMIndex:
    """Symbols 0 (end) to ``top``; text ends in the only 0."""

    def __init__(self, text: np.ndarray, top: int) -> None:
        n = len(text)
        suffixes = self._suffix_array(text)
        bwt = text[suffixes - 1]
        self.n, self.before = n, np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.bits = max(1, int(top).bit_length())
        self.zeros, self.ones = [], []  # wavelet matrix: per bit, how many zeros, and ones before each place
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(n - self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.bwt = bwt
        marked = suffixes % SAMPLE == 0
        self.marks = np.concatenate(([0], np.cumsum(marked))).astype(np.int32)
        self.samples = suffixes[marked]

    @staticmethod
    def _suffix_array(text: np.ndarray) -> np.ndarray:
        """Prefix doubling until all ranks differ."""
        n, rank, k = len(text), text.astype(np.int64), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1
            key = rank * (max(n, int(rank.max())) + 2) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            if rank[order[-1]] == n - 1 or k >= n:
                return order
            k *= 2

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        start, end = np.zeros_like(places), places.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((symbols >> b) & 1).astype(bool)
            s, e = ones[start], ones[end]
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Right-aligned phrases (rows) -> place ranges [lo, hi) of the suffixes they start."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for step in range(width):
            live = np.flatnonzero((step < lengths) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, width - 1 - step]
            lo[live], hi[live] = self.before[c] + self.rank(c, lo[live]), self.before[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at these places."""
        out, steps = np.zeros(len(places), np.int64), 0
        todo, at = np.arange(len(places)), places.astype(np.int64)
        while len(todo):
            here = self.marks[at + 1] > self.marks[at]
            out[todo[here]] = self.samples[self.marks[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            c = self.bwt[at]
            at = self.before[c] + self.rank(c, at)
            steps += 1
        return out


def phrases_of(items: list[tuple[str, str | None]]) -> tuple[list[str], dict, np.ndarray, np.ndarray, list[list[int]]]:
    """Items (item_id, text) -> item ids, word symbols (from 2), right-aligned
    phrases, their lengths, and the items of each phrase."""
    symbols: dict[bytes, int] = {}
    found: dict[tuple[int, ...], list[int]] = {}
    for k, (_, text) in enumerate(items):
        ids = [symbols.setdefault(w, len(symbols) + 2) for w in words_of(text)]
        for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
            who = found.setdefault(tuple(ids[i : i + WINDOW]), [])
            if not who or who[-1] != k:
                who.append(k)
    phrases = np.zeros((len(found), WINDOW), np.int64)
    for row, p in zip(phrases, found):
        row[WINDOW - len(p) :] = p
    return [i for i, _ in items], symbols, phrases, np.array([len(p) for p in found], np.int64), list(found.values())


def long_runs(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of phrase words (nonzero) of at least ``least`` words."""
    known = np.concatenate(([False], ids > 0, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]


_HITS = "doc_id bigint, row_id bigint, n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def searcher(block):
    """The mapInArrow function; ``block`` is a broadcast of phrases_of()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, symbols, phrases, lengths, owners = block.value
        least = int(lengths.min()) if len(lengths) else 1 << 30
        rows: list[tuple] = []
        runs: list[tuple[int, int, np.ndarray]] = []  # document, first word, symbols
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, runs, size
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            if runs:
                text = np.concatenate([x for _, _, r in runs for x in (r, np.ones(1, np.int64))] + [np.zeros(1, np.int64)])
                starts = np.cumsum([0] + [len(r) + 1 for _, _, r in runs])[:-1]
                index = FMIndex(text, len(symbols) + 1)
                lo, hi = index.search(phrases, lengths)
                hit = np.flatnonzero(lo < hi)
                which = np.repeat(hit, hi[hit] - lo[hit])
                places = np.concatenate([np.arange(lo[k], hi[k]) for k in hit] or [np.zeros(0, np.int64)])
                positions = index.locate(places)
                run_of = np.searchsorted(starts, positions, side="right") - 1
                for k, p, r in zip(which.tolist(), positions.tolist(), run_of.tolist()):
                    doc, first, _ = runs[r]
                    a = first + p - int(starts[r])
                    spans.setdefault(doc, []).append((a, a + int(lengths[k])))
                    items.setdefault(doc, set()).update(owners[k])
            out_spans = [[{"first": a, "last": z} for a, z in merge_spans(spans.get(i, []))] for i in range(len(rows))]
            out_items = [sorted({names[k] for k in items.get(i, ())}) for i in range(len(rows))]
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(out_spans, _SPANS), pa.array(out_items, pa.list_(pa.string()))]
            rows, runs, size = [], [], 0
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "row_id", "n_words", "spans", "items"])

        for b in batches:
            for doc, row, text in zip(b.column("doc_id").to_pylist(), b.column("row_id").to_pylist(), b.column("text")):
                words = words_of(text.as_py())
                ids = np.fromiter((symbols.get(w, 0) for w in words), np.int64, len(words))
                for a, z in long_runs(ids, least):
                    runs.append((len(rows), a, ids[a:z]))
                    size += z - a + 1
                rows.append((doc, row, len(words)))
                if size >= SHARD or len(rows) >= SHARD_DOCS:
                    yield flush()
        if rows:
            yield flush()

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents (doc_id, text), benchmark (item_id, text) -> doc_id, row_id (a
    hash of the text), n_words, spans (removal spans in words) and items (sorted)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_id"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    found = None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(phrases_of([(r[0], r[1]) for r in part.collect()]))
        hits = docs.mapInArrow(searcher(block), _HITS)
        found = hits if found is None else found.union(hits)
    if blocks == 1:
        return found
    both = found.groupBy("doc_id", "row_id", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = both.mapInArrow(_merge, _HITS)
    keys = docs.select(F.col("doc_id").alias("k_doc"), F.col("row_id").alias("k_row"))  # repeated rows come back as often as they are
    return keys.join(merged, keys.k_doc.eqNullSafe(merged.doc_id) & (keys.k_row == merged.row_id)).select(*merged.columns)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins a document's spans of several blocks."""
    for b in batches:
        spans = [[{"first": a, "last": z} for a, z in merge_spans([(s["first"], s["last"]) for s in row])] for row in b.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_id"), b.column("n_words"), pa.array(spans, _SPANS), b.column("items")], ["doc_id", "row_id", "n_words", "spans", "items"])


def op7_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    out = out.withColumn("n_hit", hit)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
