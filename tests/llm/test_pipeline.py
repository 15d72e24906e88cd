"""The language coder, the fingerprints and the whole pipeline against plain
Python versions of their definitions, odd rows and empty tables."""

import collections
import itertools
import math
import re
import struct
import zlib

import pytest
import regex
import xxhash

import corpus_pipeline
import public_tokenizers
from carrylens.llm import op1_spotsigs as spots
from carrylens.llm import queries as Q
from carrylens.llm.op2_packing import END, LENGTH
from carrylens.llm.op8_language import ORDER

from test_operators import LONG, PASSAGE, ROWS, SF, _plain_spans, classes

NAMES = "lang_pred int, score string, kept string, row_id string, component_id string, spans string, h_doc int, h_row int, place int, row string, next_text string"
CLASH = (1, "s", "k", "r", "c", "sp", 2, 3, 4, "row", "nt")


class PlainCoder:
    """Prediction by partial matching with escapes of method C: counts of followers by context, one byte at a time."""

    def __init__(self, rows):
        self.seen = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
        for lang, text in rows:
            data = text.encode("utf-8", "surrogatepass")
            for i, byte in enumerate(data):
                for order in range(min(i, ORDER) + 1):
                    self.seen[lang][data[i - order : i]][byte] += 1

    def bits(self, lang, data):
        total = 0.0
        for i, byte in enumerate(data):
            for order in range(min(i, ORDER), -1, -1):
                followers = self.seen[lang].get(data[i - order : i])
                if followers is None:
                    continue
                mass = sum(followers.values()) + len(followers)
                if byte in followers:
                    total -= math.log2(followers[byte] / mass)
                    break
                total -= math.log2(len(followers) / mass)
            else:
                total += 8
        return total

    def predict(self, text):
        """(language, score, bits a byte)"""
        if not self.seen or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, None
        data = text.encode("utf-8", "surrogatepass")
        bits = {lang: self.bits(lang, data) for lang in sorted(self.seen)}
        best = min(bits, key=bits.get)
        return best, 1 / sum(2.0 ** max(-1000.0, bits[best] - b) for b in bits.values()), bits[best] / len(data)


def coder_of(rows):
    """Learned from (doc_id, text, lang) rows that are not held out."""
    learned = {(i, t, lang) for i, t, lang in rows if None not in (i, t, lang) and zlib.crc32(str(i).encode()) % 4 != 2}
    return PlainCoder([(lang, t) for _, t, lang in sorted(learned)])


def test_op8_is_the_plain_coder_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    coder, text = coder_of(rows), {i: t for i, t, _ in rows}
    got = Q.QUERIES["op8_ppm_language"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        lang, score, rate = coder.predict(text[r.doc_id])
        assert (r.lang_pred, r.held_out) == (lang, zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert abs(r.score - score) < 1e-3 and (r.bits_a_byte is None) == (rate is None)
        assert rate is None or abs(r.bits_a_byte - rate) < 1e-4 * rate


def signatures(text):
    """An anchor and the next content words, for every anchor that a content word follows."""
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split()
    out = set()
    for k, w in enumerate(words[:-1]):
        if w in spots.ANCHORS and words[k + 1] not in spots.ANCHORS:
            content = itertools.islice((words[j] for j in range(k + 1, len(words)) if words[j] not in spots.ANCHORS), spots.CHAIN)
            out.add(xxhash.xxh64_intdigest(" ".join([w, *content]), seed=42))
    if not out and text:
        first, tag = (" ".join(words), 0) if words else (text, 1)
        out.add(xxhash.xxh64_intdigest(struct.pack("<i", tag), seed=xxhash.xxh64_intdigest(first, seed=42)))
    return out


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op1_is_the_plain_version_on_the_whole_table(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in Q.QUERIES["op1_spotsigs"](spark, SF).collect()}
    assert len(got) == len(rows)
    text_of = lambda s: "".join(f"{x:016x}" for x in sorted(s, key=lambda x: x - (x >> 63 << 64)))
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        own, other, after = signatures(t), signatures(t[: len(t) - len(t) // 2] + following[: len(t) // 2]), signatures(following)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (text_of(own), text_of(other))
        assert abs(got[i].near_edited - likeness(own, other)) < 1e-12 and abs(got[i].near_next - likeness(own, after)) < 1e-12


def test_op1_edges(spark):
    """Nulls, repeated rows, a null id, clashing names, a text of one anchor a word, and a text of 300,000 words."""
    rows = [(1, None), (2, ""), (3, "?!"), (4, "the"), (5, "the the the"), (6, "of the word"), (7, "the one"), (7, "the one"), (None, "the one"), (8, "the w " * 300_000), (9, "word " * 300_000)]
    frame = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in rows], "doc_id bigint, text string, n_chars int, signatures string, next_text string")
    got = collections.Counter((r.doc_id, r.text, frozenset(x % 2**64 for x in r.signatures)) for r in spots.fingerprints(frame).collect())
    assert got == collections.Counter((i, t or "", frozenset(signatures(t or ""))) for i, t in rows)
    edited = {r.doc_id: r for r in spots.edited(frame).collect()}
    assert edited[9].next_text == "the w " * 300_000 and edited[2].next_text == "" and edited[1].next_text == "word " * 300_000
    assert edited[7].edited_text == "the " + "of " and edited[None].next_text == ""
    assert spots.edited(frame.limit(0)).collect() == [] and spots.similar(frame.limit(0)).collect() == []


def packed_texts(rows):
    """Pieces of pack_documents -> the ids of every document, after checks of the sequences."""
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= LENGTH
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for pieces in sequences.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= LENGTH
    out = collections.Counter()
    for (doc, n), pieces in documents.items():
        by_start = collections.defaultdict(list)
        for start, ids in pieces:
            by_start[start].append(bytes(ids))
        # rows that share an id and a length are told apart by following the pieces from start to end
        for first in by_start.pop(0):
            ids = first
            while len(ids) < 4 * n:
                ids += by_start[len(ids) // 4].pop(0)
            out[doc, ids] += 1
        assert not any(by_start.values())
    return out


def plain_run(rows, benchmark):
    """(doc_id, text) of what is packed in the end: the first four stages one by one."""
    coder = coder_of(rows)
    named = [(i, t, *coder.predict(t)) for i, t, _ in rows]
    kept = [(i, t) for i, t, lang, _, rate in named if lang != "und" and rate < 8]
    leader = classes(kept)
    first = {}
    for i, t in kept:
        if i is not None and leader[i] == i:
            first[i] = min(first.get(i, t), t)
    kept = [(i, t) for i, t in kept if i is None] + list(first.items())
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for item, t in benchmark:
        w = words(t) if item is not None else []
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[min(10, len(w))].add(tuple(w[k : k + 10]))

    def clean(t):
        w = words(t)
        return not any(tuple(w[k : k + n]) in of_n for n, of_n in windows.items() for k in range(len(w) - n + 1))

    def redacted(t):
        out, at = "", 0
        for a, z, kind in sorted((a, z, k) for k, a, z in _plain_spans(t)):
            if a >= at:
                out += t[at:a] + "[" + ("EMAIL", "IP", "CARD", "PHONE")[kind] + "]"
            at = max(at, z)
        return out + t[at:]

    return collections.Counter((i, redacted(t)) for i, t in kept if clean(t))


def ids_of(texts):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return collections.Counter({(i, b"".join(x.to_bytes(4, "little") for x in [*full.encode(t, add_special_tokens=False).ids, END])): n for (i, t), n in texts.items()})


def test_pipeline_is_the_plain_version_on_whole_tables(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain_run(rows, benchmark)
    assert 0 < len(want) < len(rows)
    assert packed_texts(corpus_pipeline.run(spark, SF).collect()) == ids_of(want)


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """documents with nulls, repeated rows, long texts, every kind of personal data and names that the stages use themselves."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en") for i, t in ROWS] + [
        (20, "write to a@b.co or a@1.2.3.4 soon", "en"), (21, "card 4111 1111 1111 1111 and +49 30 123456", None), (22, "Benchmark Words, stand here", "en"), (23, "un texte en français", "fr"),
        (24, "un texte en français", "fr"), (24, "un autre texte", "fr"), (None, "benchmark words stand", "en"), (None, None, None), (25, "4111", "en"), (26, LONG + " " + PASSAGE, "en"), (27, "日本語の文章です", "fr"),
    ]
    spark.createDataFrame([(i, t, lang, "src", len(t or ""), *CLASH) for i, t, lang in rows], f"doc_id bigint, text string, lang string, source string, n_chars int, {NAMES}").write.parquet(f"{path}/documents.parquet")
    benchmark = [("1", "benchmark words STAND"), ("1", "benchmark words STAND"), ("2", None), (None, "un autre"), ("3", "")]
    spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, benchmark


def test_pipeline_is_the_plain_version_on_odd_rows(spark, odd_tables):
    path, rows, benchmark = odd_tables
    assert packed_texts(corpus_pipeline.run(spark, path).collect()) == ids_of(plain_run(rows, benchmark))


def test_pipeline_stages_keep_the_columns(spark, odd_tables):
    path, _, _ = odd_tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
        assert all(tuple(r)[5:] == CLASH for r in out.collect()), name


def test_pipeline_of_empty_tables(spark, odd_tables, tmp_path):
    path, _, _ = odd_tables
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
