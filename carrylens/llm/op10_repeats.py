"""Repeated word passages by seed and extend.

Seeds are winnowed: of every run of 50 words the 10-word gram with the least
hash is the anchor, so equal 50-word windows choose equal anchors at equal
places.  Documents are joined on anchors that several documents hold.  An anchor's
occurrences are extended in order of their doc_id: window by window to the left
and to the right of the anchor against the leaders so far, the first of which
is the smallest doc_id's occurrence.  Windows that a leader has are matched;
with those that no leader has, an occurrence becomes a leader of the later
ones, so no repeat is lost where two documents share more with each other than
with the first.  Runs of matched windows are the maximal repeats; those at
least 50 words long count.

Scale: anchors are counted before the shuffle; an anchor costs a row per
document and window list, never a pair of occurrences, and a text that goes
round and round has one row for all rounds.  Occurrences of a hot anchor are
dealt over portions of about ``PORTION`` that each get a copy of the first
leader; what a portion's leaders don't settle among themselves is one row per
portion, document and window, and is compared between that anchor's portions.
A task holds the leaders of one portion.  Windows are compared by 64-bit hashes
among one anchor's occurrences only, so unlike windows are taken for equal with
a probability of 2**-64 a comparison.  Exact copies are recognised by digest
and not seeded at all.

Edge cases: null or wordless texts keep nothing and lose nothing; a text of
fewer than 50 words has no window; rows with one doc_id never remove from each
other; a null doc_id neither removes nor is removed from; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrylens.llm.common import RangeHash, merge_spans, table, window_argmin, written

WINDOW = 50
GRAM = 10
PORTION = 4000  # rows of an anchor that one task holds, with a copy of the first leader


class Words:
    """A text's words, the hashes of its grams and windows, and each window's anchor."""

    def __init__(self, text: str | None) -> None:
        self.words = (text or "").encode("utf-8", "surrogatepass").split()
        self.data = b" ".join(self.words)
        self.windows = max(0, len(self.words) - WINDOW + 1)

    def seed(self) -> None:
        """Fills ``hashes`` (of windows) and ``anchor`` (place of each window's anchor)."""
        lengths = np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        ranges = RangeHash(self.data)
        self.grams = ranges.of(starts[: len(starts) - GRAM + 1], ends[GRAM - 1 :])
        self.hashes = ranges.of(starts[: self.windows], ends[WINDOW - 1 :])
        self.anchor = window_argmin(self.grams, WINDOW - GRAM + 1)


_SEEDED = "doc_id bigint, row_id bigint, n_words bigint, digest binary, anchors array<bigint>"


def _seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, digests, anchors = [], [], []
        for text in b.column("text").to_pylist():
            w = Words(text)
            counts.append(len(w.words))
            digests.append(hashlib.blake2b(w.data, digest_size=16).digest())
            if w.windows:
                w.seed()
                anchors.append(np.unique(w.grams[w.anchor]).view(np.int64))
            else:
                anchors.append(None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], ["doc_id", "row_id", "n_words", "digest", "anchors"])


_SEEDS = "anchor bigint, member boolean, doc_id bigint, row_id bigint, firsts array<bigint>, hashes array<bigint>"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row_id, text, shared, led): the occurrences of shared
    anchors with the hashes of the windows that chose them, one row for all
    that have the same windows.  ``firsts`` are the places of the first ones."""
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        for doc, row, text, shared, led in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row_id", "text", "shared", "led"))):
            w = Words(text)
            w.seed()
            cut = np.flatnonzero(np.diff(w.anchor)) + 1  # an anchor's windows are neighbours
            firsts, lasts = np.concatenate(([0], cut)), np.concatenate((cut, [w.windows]))
            names = w.grams[w.anchor[firsts]].view(np.int64)
            order = np.argsort(shared := np.array(shared, dtype=np.int64))
            shared, led = shared[order], np.array(led, dtype=bool)[order]
            where = np.minimum(np.searchsorted(shared, names), len(shared) - 1)
            rounds: dict[tuple[int, bytes], list[int]] = {}
            for k in np.flatnonzero(shared[where] == names).tolist():
                rounds.setdefault((int(names[k]), w.hashes[firsts[k] : lasts[k]].tobytes()), []).append(k)
            leads: set[int] = set()
            for (name, hashes), places in rounds.items():
                leader = bool(led[where[places[0]]]) and name not in leads
                leads.add(name)
                for col, v in zip(cols, (name, not leader, doc, row, firsts[places], np.frombuffer(hashes, dtype=np.int64))):
                    col.append(v)
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["anchor", "member", "doc_id", "row_id", "firsts", "hashes"])


_EXTENDED = "anchor bigint, doc_id bigint, row_id bigint, first bigint, last bigint, open bigint, starts array<bigint>"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, portion, member, doc_id): runs [first, last) of
    windows that a smaller doc_id's occurrence in this portion has; of anchors
    with several portions also the windows of its leaders (``open``), once a
    row with all their places."""
    key, leader_of, opened = None, {}, {}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 7
        types = [pa.int64()] * 6 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["anchor", "doc_id", "row_id", "first", "last", "open", "starts"])

    def settled() -> list[tuple]:
        return [(key[0], doc, row, None, None, h, starts) for (doc, row, h), starts in opened.items()]

    for b in batches:
        out: list[tuple] = []
        for anchor, portion, portions, doc, row, firsts, hashes in zip(*(b.column(c).to_pylist() for c in ("anchor", "portion", "portions", "doc_id", "row_id", "firsts", "hashes"))):
            if (anchor, portion) != key:
                out += settled()
                key, leader_of, opened = (anchor, portion), {}, {}
            runs: list[list[int]] = []
            for k, h in enumerate(hashes):
                if leader_of.setdefault(h, doc) < doc:
                    if runs and runs[-1][1] == k:
                        runs[-1][1] = k + 1
                    else:
                        runs.append([k, k + 1])
                elif portions > 1:
                    opened.setdefault((doc, row, h), []).extend(f + k for f in firsts)
            if runs:
                out += [(anchor, doc, row, a, z, None, None) for a, z in merge_spans([(f + a, f + z) for f in firsts for a, z in runs])]
        yield batch(out)
    if opened:
        yield batch(settled())


_KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, removed, kept = [], [], []
        for text, spans, copy in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "copy"))):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            keep, last = [], 0
            for a, z in [(0, len(words))] if copy else merge_spans([(s["first"], s["last"] + WINDOW - 1) for s in spans or ()]):
                keep += words[last:a]
                last = z
            keep += words[last:]
            total.append(len(words))
            removed.append(len(words) - len(keep))
            kept.append(b" ".join(keep).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def repeat_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (doc_id, row_id, text) -> (rows, spans): every row with its
    ``copy`` flag (all its words are those of a smaller doc_id), and the runs
    [first, last) of windows that a smaller doc_id holds, of the other rows."""
    seeded = written(docs.mapInArrow(_seed, _SEEDED), "seeded")
    long = seeded.filter(f"n_words >= {WINDOW} and doc_id is not null")
    least = long.groupBy("digest").agg(F.min("doc_id").alias("least"))
    rows = written(seeded.select("doc_id", "row_id", "n_words", "digest").join(least, "digest", "left")
                   .select("doc_id", "row_id", (F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)) & (F.col("n_words") >= WINDOW)).alias("copy")), "rows")
    seeds = (long.join(rows.filter("not copy and doc_id is not null").dropDuplicates(["doc_id", "row_id"]), ["doc_id", "row_id"], "left_semi")
             .dropDuplicates(["doc_id", "row_id"]).select("doc_id", "row_id", F.explode("anchors").alias("anchor")))
    seeds = written(seeds, "seeds")
    shared = seeds.groupBy("anchor").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader < last")
    shared = written(shared.select("anchor", "leader"), "shared")
    held = (seeds.join(shared, "anchor").groupBy("doc_id", "row_id")
            .agg(F.collect_list(F.struct("anchor", (F.col("leader") == F.col("doc_id")).alias("led"))).alias("held"))
            .select("doc_id", "row_id", F.col("held.anchor").alias("shared"), F.col("held.led").alias("led")))
    texts = docs.join(held, ["doc_id", "row_id"])
    found = written(texts.mapInArrow(_occurrences, _SEEDS), "occurrences")
    portions = found.groupBy("anchor").agg(F.ceil(F.count("*") / PORTION).alias("portions")).filter("portions > 1")
    found = found.join(portions, "anchor", "left").withColumn("portions", F.coalesce("portions", F.lit(1)))
    member = found.filter("member").withColumn("portion", F.pmod(F.xxhash64("doc_id", "firsts"), F.col("portions")))
    leads = found.filter("not member").withColumn("portion", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("portions") - 1)))
    dealt = member.unionByName(leads).repartition("anchor", "portion").sortWithinPartitions("anchor", "portion", "member", "doc_id", "row_id", "firsts")
    matched = written(dealt.mapInArrow(_extend, _EXTENDED), "extended")
    # between the portions of an anchor: the leaders' windows
    opened = matched.filter("open is not null")
    least = opened.groupBy("anchor", "open").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    rest = opened.join(least, ["anchor", "open"]).filter("doc_id > least").select("doc_id", "row_id", F.explode("starts").alias("first"))
    return rows, matched.filter("open is null").select("doc_id", "row_id", "first", "last").union(rest.withColumn("last", F.col("first") + 1))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_words, n_removed, kept_text."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_id"))
    rows, spans = repeat_spans(docs)
    spans = spans.groupBy("doc_id", "row_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    marks = (rows.filter("copy").select("doc_id", "row_id", "copy").distinct().withColumn("spans", F.lit(None).cast("array<struct<first:bigint,last:bigint>>"))
             .unionByName(spans.withColumn("copy", F.lit(False))))
    return docs.join(marks, ["doc_id", "row_id"], "left").select("doc_id", "text", "spans", "copy").mapInArrow(_cut, _KEPT)


def op10_seed_extend_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
