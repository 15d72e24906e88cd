"""Every operator against brute force on the small tables and on a fixture of
edge cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrylens.llm import queries as Q
from carrylens.llm.op3_minhash import near_duplicates
from carrylens.llm.op4_licenses import RULES, SENTENCES, SLOTS, WORDINGS, scan, short_sentences
from carrylens.llm.op5_suffix_repeats import intervals, remove_repeats as remove_bytes
from carrylens.llm.op6_personal import KINDS, personal_data, redact
from carrylens.llm.op7_decontaminate import FMIndex, decontaminate
from carrylens.llm.op8_language import identify
from carrylens.llm.op9_pages import extract
from carrylens.llm.op10_repeats import remove_repeats as remove_words
from carrylens.llm.op1_spotsigs import fingerprints, similar
from carrylens.llm.op2_packing import LENGTH, encoder, pack, pack_documents

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7 % 1013}x{i}" for i in range(4000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))
ROWS = [  # doc_id, text
    (1, None), (2, ""), (3, "   \n"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, LONG), (7, LONG + " tail"),
    (8, "start of eight " + PASSAGE + " end of eight"), (9, "nine begins " + PASSAGE + " and nine ends"), (10, "ab " * 300), (11, "ab " * 300 + "c"),
    (12, "a" * 49), (13, "a" * 50), (14, "a" * 120), (15, "é" * 60 + " ünïcode"), (16, "é" * 60 + " ünïcode"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", 0, "clash", True, 1) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept boolean, row_id bigint")


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def cut(rows, split, width, join):
    """What windows of a smaller doc_id remove, by brute force."""
    first = {}
    for i, t in rows:
        units = split(t or "")
        for j in range(len(units) - width + 1):
            k = tuple(units[j : j + width])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        units = split(t or "")
        gone = [False] * len(units)
        for j in range(len(units) - width + 1):
            if i is not None and first[tuple(units[j : j + width])] < i:
                gone[j : j + width] = [True] * width
        out.append((i, len(units), sum(gone), join(u for u, g in zip(units, gone) if not g)))
    return collections.Counter(out)


def test_op10_words(spark, docs, small):
    split, join = lambda t: t.encode().split(), lambda u: b" ".join(u).decode()
    for frame, rows in ((docs, ROWS), (spark.createDataFrame(small, "doc_id bigint, text string"), small)):
        assert collections.Counter(map(tuple, remove_words(frame).collect())) == cut(rows, split, 50, join)


@pytest.mark.parametrize("portion", [1, 2, 7, 4000])
def test_op10_hot_anchors_are_dealt_over_portions(spark, monkeypatch, portion):
    """A frequent passage with every kind of neighbourhood, texts that go round
    and round, and repeats between documents that the smallest one doesn't have."""
    from carrylens.llm import op10_repeats

    monkeypatch.setattr(op10_repeats, "PORTION", portion)
    split, join = lambda t: t.encode().split(), lambda u: b" ".join(u).decode()
    tails = ["alpha " * 3, " ".join(f"t{i}" for i in range(40)), " ".join(f"t{i}" for i in range(25)) + " other", ""]
    rows = [(i, f"{'x ' * (i % 3)}{tails[i % 4][::-1]} {PASSAGE} {tails[(i // 2) % 4]} end{i % 5}") for i in range(40)]
    rows += [(100 + i, "ping pong " * (30 + 13 * i)) for i in range(9)] + [(90, "pong ping " * 200), (3, "pong " + "ping pong " * 90), (200, "go " * 400), (201, "go " * 60 + "stop " + "go " * 55)]
    got = remove_words(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert collections.Counter(map(tuple, got.collect())) == cut(rows, split, 50, join)


def test_op5_bytes(spark, docs, small):
    split, join = lambda t: t.encode(), lambda u: bytes(u)
    for frame, rows in ((docs, ROWS), (spark.createDataFrame(small[:120], "doc_id bigint, text string"), small[:120])):
        got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in remove_bytes(frame).collect())
        assert got == cut(rows, split, 50, join)


def test_op5_hot_grams_are_settled_by_windows(spark, docs, monkeypatch):
    import carrylens.llm.op5_suffix_repeats as m

    monkeypatch.setattr(m, "HOT", 1)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in remove_bytes(docs).collect())
    assert got == cut(ROWS, lambda t: t.encode(), 50, lambda u: bytes(u))


def test_intervals_of_a_known_array():
    # suffixes of banana: a, ana, anana, banana, na, nana
    assert sorted(intervals([1, 3, 0, 0, 2], 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def classes(rows):
    sets, parent = collections.defaultdict(list), {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            parent[i] = i
            sets[i].append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for a in ids:
        for b in ids:
            if a < b and any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_op3_components(spark, docs, small):
    for frame, rows in ((docs, ROWS), (spark.createDataFrame(small, "doc_id bigint, text string"), small)):
        want, got = classes(rows), near_duplicates(frame).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in got)


@pytest.mark.parametrize("split", [1, 2, 5])
def test_op3_crowded_buckets_lose_no_pair(spark, monkeypatch, split):
    """Chains of near copies, whose ends are unlike each other, in buckets of any size against brute force."""
    from carrylens.llm import op3_minhash

    words = [f"w{i}" for i in range(400)]
    rows = [(k * 7 % 61, " ".join(words[4 * k : 4 * k + 120])) for k in range(61)]  # overlap falls from link to link
    rows += [(100 + k, " ".join(words[:200] + [f"e{k}x{i}" for i in range(12 + 3 * k)])) for k in range(12)]
    monkeypatch.setattr(op3_minhash, "SPLIT", split)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}
    assert len({find(i) for i in sets}) > 1


def test_op3_empty_table(docs):
    assert near_duplicates(docs.limit(0)).count() == 0


def test_op2_round_trip(docs):
    import public_tokenizers as P

    exact = encoder(P.path("byte_bpe_50k.json") + "")  # the tokenizer file alone is the yardstick
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = ["<|endoftext|> a", "日本語 text", "naïve  \n\n x", LONG]
    assert all(exact(t) == tok.encode(t, add_special_tokens=False).ids for t in texts)
    rows = pack_documents(docs).collect()
    want = collections.Counter()
    for i, t in ROWS:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in rows:
        got[r.doc_id] += r.length
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) >= 0
    assert got == want
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= LENGTH and at & (at - 1) == 0  # no padding at all


def test_op2_ids_are_those_of_the_call(spark, small):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)  # with its default flags
    rows = [(i, t) for i, (_, t) in enumerate(small)]
    rows += [(1000 + i, t) for i, t in enumerate(["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "naïve<|endoftext|>\n\n x", "日本<|endoftext|>語", "<|endoftext", LONG])]
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    fast = encoder(path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, added=True)
    assert all([*fast(t or ""), 1] == want[i] for i, t in rows)
    got = collections.defaultdict(list)
    for r in sorted(pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), key=lambda r: r.start):
        got[r.doc_id] += np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.doc_tokens == len(want[r.doc_id])
    assert got == want


def test_op2_costs_are_balanced():
    rng = np.random.default_rng(3)
    pieces = pack([int(x) for x in rng.integers(1, 1500, 4000)])
    cost = collections.Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 4096
    values = np.array(list(cost.values()))
    assert values.std() / values.mean() < 0.15


def test_op6_base_and_discovered(spark):
    rows = [(i, f"Reach agent on account name{i}@mail.example.com now") for i in range(8)]
    rows += [(100, "Reach agent on account hidden@localhost now"), (101, None), (102, "+1 (988) 555-2485, 1.2.3.300 and 42.144.35.254 or 4539 1488 0343 6467")]
    out = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [KINDS[s.kind] for s in out[100].spans] == ["email"] and not out[100].base
    assert out[101].spans == []
    assert [(KINDS[s.kind], rows[10][1][s.first : s.last]) for s in out[102].base] == [("ip", "42.144.35.254"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (988) 555-2485")]


def test_op6_instances_make_new_patterns(spark):
    """Numbers accepted after "call me" make "ring us" a pattern, which finds one that never follows a seed's words."""
    base = [f"please call me +49 30 12345{k:02d} now" for k in range(24)]
    bridge = [f"please call me 030-12345{k:02d} x" for k in range(4)] + [f"or ring us 030-12345{k:02d} x" for k in range(4)]
    other = ["or ring us 030-9999999 x", "order of size 030-7777777 x"]
    rows = list(enumerate(base + bridge + other))
    out = {r.doc_id: [KINDS[s.kind] for s in r.spans] for r in personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [out[k] for k in range(33)] == [["phone"]] * 33 and out[33] == []
    alone = {r.doc_id: len(r.spans) for r in personal_data(spark.createDataFrame(rows[:24] + rows[28:], "doc_id bigint, text string")).collect()}
    assert not any(alone[k] for k in range(28, 34))  # without the bridge nothing leads to them


def _plain_spans(text):
    """The contract's base spans in plain Python."""
    def luhn(d):
        twice = [int(x) * 2 for x in d[-2::-2]]
        return (sum(map(int, d[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0

    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, (rule, good) in enumerate(rules) for m in re.finditer(rule, text) if good(m.group())]


def test_op6_base_spans_of_all_kinds_against_brute_force(spark):
    import random

    rng = random.Random(6)
    pieces = ["a", "b.c", "@", ".", "+", "-", " ", "(", ")", "%", "é", "😀", "0", "10", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "5500-0000-0000-0004", "+49 30 123456", "x@y.z", "7", "12345", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    got = personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: [tuple(s) for s in r.base] for r in got} == {k: _plain_spans(t) for k, t in enumerate(texts)}


def test_op6_base_ips_with_any_parts(spark):
    parts = ["0", "00", "010", "255", "256"]
    texts = [f"at {a}.{b}.{c}.{d}, x" for a in parts for b in parts for c in parts for d in parts] + ["10.0.0.1 127.0.0.1", "0.0.0.0", "1.2.3", f"{'0' * 5000}.0.0.{'0' * 5000}256"]
    want = {}
    for i, t in enumerate(texts):  # four runs of digits, each at most 255
        found = re.finditer(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}", t)
        want[i] = [(m.start(), m.end()) for m in found if all(int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    got = personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: [(s["first"], s["last"]) for s in r.base if KINDS[s["kind"]] == "ip"] for r in got} == want


def test_op6_redaction(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a x@y.zz b 1.2.3.4")], "doc_id bigint, text string")
    out = personal_data(df).join(df, "doc_id").select(redact(F.col("text"), F.col("spans")).alias("t")).first()
    assert out.t == "a [EMAIL] b [IP]"


def test_op7_windows(spark, docs):
    bench = spark.createDataFrame([(1, "Shared3 shared4, shared5 shared6 shared7 shared8 shared9 shared10 shared11 shared12 shared13"), (2, "one TWO"), (3, None), (None, "one two"), (4, "!?"), (5, "one-two")], "item_id bigint, text string")
    got = sorted(((r.doc_id or -1, r.n_words, [tuple(s) for s in r.spans], list(r["items"])) for r in decontaminate(docs, bench).collect()))
    hit = {(i, tuple(s), tuple(x)) for i, _, s, x in got if s}
    assert hit == {(-1, ((0, 2),), ("2", "5")), (4, ((0, 2),), ("2", "5")), (5, ((0, 2),), ("2", "5")), (8, ((6, 17),), ("1",)), (9, ((5, 16),), ("1",))}
    assert len(got) == len(ROWS)
    assert all(not r.spans for r in decontaminate(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("block_bytes", [8 << 20, 16])  # one block, several
def test_op7_items_are_listed_once(spark, docs, monkeypatch, block_bytes):
    import carrylens.llm.op7_decontaminate as m

    rows = [(1, "one two"), (1, "one two"), (2, "ONE two"), (3, "shared3 shared4 shared5"), (3, "shared4 shared5 shared6"), (3, "shared9 shared10"), (4, "nowhere at all")]
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    monkeypatch.setattr(m, "BLOCK_BYTES", block_bytes)
    got = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in decontaminate(docs, bench).collect())
    hits = {"one two": (((0, 2),), ("1", "2")), ROWS[9][1]: (((6, 10), (12, 14)), ("3",)), ROWS[10][1]: (((5, 9), (11, 13)), ("3",))}
    want = collections.Counter((i, len((t or "").encode().split()), *hits.get(t, ((), ()))) for i, t in ROWS)
    assert got == want


def test_op7_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 5, 3000), 0)
    index = FMIndex(text, 4)
    for _ in range(50):
        n = int(rng.integers(1, 6))
        phrase = rng.integers(1, 5, n)
        padded = np.zeros((1, 10), np.int64)
        padded[0, 10 - n :] = phrase
        lo, hi = index.search(padded, np.array([n]))
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrase).all()]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_op8_accuracy_and_edges(spark, docs):
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = Q.QUERIES["op8_ppm_language"](spark, "/root/testdata/sf0.01").join(full.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)
    got = identify(docs, full).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if not r.text or not r.text.strip())
    assert {r.lang_pred for r in identify(docs, full.limit(0)).collect()} == {"und"}


def test_op8_sample_has_no_undefined_ties(spark, monkeypatch):
    """Repeated ids and rows: distinct (doc_id, text) count, whatever the partitions."""
    from carrylens.llm import op8_language

    monkeypatch.setattr(op8_language, "SAMPLE", 5)
    rows = [(i % 4 * 4, f"text {i % 3}", lang) for i in range(60) for lang in ("en", "fr")] + [(1, None, "en"), (None, "x", "en"), (3, "y", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    picks = [collections.Counter(map(tuple, op8_language.sampled(frame.repartition(n)).collect())) for n in (1, 3, 7)]
    assert picks[0] == picks[1] == picks[2]
    assert {lang: sum(n for (x, _), n in picks[0].items() if x == lang) for lang in ("en", "fr")} == {"en": 5, "fr": 5}
    assert op8_language.sampled(frame.limit(0)).collect() == []


def test_op8_learns_whole_texts(spark):
    from carrylens.llm import op8_language as m

    rng = np.random.default_rng(8)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, m.PART + 1000))
    train = spark.createDataFrame([(ids[0], "b" * 70_000 + text, "x"), (ids[1], "b" * 70_000, "y")], "doc_id bigint, text string, lang string")
    lang = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame([(1, text[-900:])], "doc_id bigint, text string"), train).collect()}
    grams = collections.Counter(text[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1))
    seen = collections.Counter()
    import pyarrow as pa

    for b in m._grams(iter([pa.RecordBatch.from_pydict({"lang": ["x"], "text": [text]})])):
        for g, n in zip(b.column("gram").to_pylist(), b.column("n").to_pylist()):
            digits = []
            while g:
                g, d = divmod(g, 257)
                digits.append(chr(d - 1))
            seen["".join(reversed(digits))] += n
    assert seen == grams and lang == {1: "x"}


@pytest.mark.parametrize("dense", [0, 3, 40, 400])
def test_op8_keeps_every_context(monkeypatch, dense):
    from carrylens.llm import op8_language as m

    rng = np.random.default_rng(9)
    texts = {k: bytes(rng.choice(np.frombuffer(s, np.uint8), 700)) for k, s in (("x", b"abcde "), ("y", b"bdfgh \xc3\xa9"), ("z", b"klab"))}
    counts = {k: collections.Counter() for k in texts}
    for k, t in texts.items():
        for n in range(1, m.ORDER + 2):
            for i in range(len(t) - n + 1):
                counts[k][sum((c + 1) * 257**e for e, c in enumerate(reversed(t[i : i + n])))] += 1
    full = m.Trees(counts)
    assert full.sparse is None
    monkeypatch.setattr(m, "MOST_CONTEXTS", dense)
    part = m.Trees(counts)
    assert part.sparse is not None
    for t in [*texts.values(), b"a", b"", b"ab cd\xff ka fgh klm", b"qqab"]:
        assert np.allclose(m.code_lengths(part.tables, t), m.code_lengths(full.tables, t), rtol=1e-4)


def test_op9_pages(spark):
    page = "<html><head><title>T</title><script>var t='</p>'</script></head><body><nav><a href='/x'>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; line</h1><p><b>First\n  text<br>more</b><p>Second<aside>no</aside></p></article><div id='comments'>spam</div><footer>f</footer></body></html>"
    rows = [(i, "http://h.example/p", page) for i in range(5)] + [(9, None, None), (10, "odd", "plain <b>text</b>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0] == "Head & line\n\nFirst text more\n\nSecond" and got[9] == "" and got[10] == "plain text" and len(got) == 7


def test_op9_articles_are_never_lost(spark):
    pages = {
        1: "<html><head><meta charset=x></head><body class='no-sidebar comments-open'><div class='has-sidebar menu-closed'><article><p>one</p><div class=share>no</div></article></div></body></html>",
        2: "<html><body><form id=aspnet><nav>no</nav><main><p>two</p></main></form></body></html>",
        3: "<html><head><title>T</title><meta charset=x><body><article><p>three</p></article></body></html>",
        4: "<html><head><link rel=x><p>four</p></html>",
        5: "<html><body class='no-sidebar'><div>five</div><footer>no</footer></body></html>",
        6: "<html><body><article><p>six</p></article><aside><article>no</article></aside><div id=comments><article>no</article></div></body></html>",
        7: "<html><body><div class=widget><article>seven</article></div><div>no</div></body></html>",
        8: "<html><body><form><div>eight</div><nav>no</nav></form></body></html>",
    }
    rows = [(i, f"http://h{i}.example/", p) for i, p in pages.items()]
    rows += [(10 + i, "http://mixed.example/", f"<html><body><nav>no</nav>{f'<article>text {i}</article>' if i < 6 else f'<div>text {i}</div>'}</body></html>") for i in range(10)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    words = "one two three four five six seven eight".split()
    assert got == dict(enumerate(words, 1)) | {10 + i: f"text {i}" for i in range(10)}


def test_op9_wording_of_the_template_is_left_out(spark):
    def page(i):
        some = "<p>On six of ten.</p>" if i < 6 else ""
        few = "<p>On four of ten.</p>" if i >= 6 else ""
        return (f"<html><body><div class=x1>Our tagline &amp; more</div><div class=x3><h1>Title {i}</h1><p>Read <b>this</b> notice.</p>{some}<p>Text {i}</p>{few}</div><div class=x2>Legal line</div></body></html>")

    rows = [(i, "http://h.example/", page(i)) for i in range(10)]
    rows += [(20 + i, "http://plain.example/", f"<div class=x1>Our tagline</div><div>Text {i}</div><button>Go</button>") for i in range(4)]
    rows += [(30 + i, "http://two.example/", "<p>Shared</p>" + f"<p>Text {i}</p>") for i in range(2)]
    rows += [(40 + i, "http://copies.example/", "<p>Copied</p>") for i in range(5)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = {i: f"Title {i}\n\nText {i}" + ("" if i < 6 else "\n\nOn four of ten.") for i in range(10)}
    want |= {20 + i: f"Text {i}" for i in range(4)} | {30 + i: f"Shared\n\nText {i}" for i in range(2)} | {40 + i: "Copied" for i in range(5)}
    assert got == want


def test_op9_what_stands_in_an_article_is_kept(spark):
    page = ("<html><body><nav>menu</nav><article><h1>T{0}</h1><h2>Method</h2><p>body {0}</p><h2>Results</h2><p>res {0}</p><div class='related-work'><p>others {0}</p></div>"
            "<section id='share-prices'>prices</section><div class='share-buttons'>no</div><div class='comment_list'>no</div><div class='sponsored'>no</div></article><footer>f</footer></body></html>")
    rows = [(i, "http://h.example/", page.format(i)) for i in range(6)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"T{i}\n\nMethod\n\nbody {i}\n\nResults\n\nres {i}\n\nothers {i}\n\nprices" for i in range(6)}


@pytest.mark.parametrize("odd", ["<script ", "<!x ", "<a '", '<a "', "<a href=", "</p ", "<!--", "<title>", "< ", "&"])
def test_op9_odd_pages_take_one_pass(odd):
    import time

    from carrylens.llm.op9_pages import blocks

    page = "<p>start</p>" + odd * (1_000_000 // len(odd))
    began = time.process_time()
    assert next(iter(list(blocks(page))))[1] == "start"
    assert time.process_time() - began < 10


def test_op9_empty_table_and_names(spark):
    rows = spark.createDataFrame([(1, "http://h/", "<p>x</p>", 5, "t", 9)], "page_id bigint, url string, html string, page bigint, template string, host int")
    assert [tuple(r) for r in extract(rows).collect()] == [(1, "http://h/", "x", 1)]
    assert extract(rows.limit(0)).collect() == []


def test_op6_long_texts_take_little_time(spark):
    """200,000 digit words, 50,000 addresses, and a plain Python version of positions and marks."""
    import time

    words = " ".join(f"n{i}" for i in range(200_000))
    mails = " ".join(f"u{i}@x.org é" for i in range(50_000))
    began = time.time()
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame([(1, words), (2, mails), (3, "no")], "doc_id bigint, text string")).collect()}
    assert not got[1].base and [(s.first, s.last) for s in got[2].base] == [m.span() for m in re.finditer(r"u\d+@x\.org", mails)]
    spans = spark.createDataFrame([(mails, [(0, *m.span()) for m in re.finditer(r"u\d+@x\.org", mails)])], "text string, spans array<struct<kind:int,first:int,last:int>>")
    assert spans.select(redact(F.col("text"), F.col("spans")).alias("t")).first().t == re.sub(r"u\d+@x\.org", "[EMAIL]", mails)
    assert time.time() - began < 60


def test_op6_empty_table_nulls_and_names(spark):
    rows = [(None, "a@b.co x"), (None, "a@b.co x"), (4, None), (4, ""), (5, "call +1 (555) 010-9999 or 10.0.0.1")]
    docs_ = spark.createDataFrame([(i, t, "c", 1, "x") for i, t in rows], "doc_id bigint, text string, base string, row_id int, spans string")
    got = sorted((r.doc_id or 0, len(r.base)) for r in personal_data(docs_).collect())
    assert got == [(0, 1), (0, 1), (4, 0), (4, 0), (5, 2)]
    assert personal_data(docs_.limit(0)).collect() == []


def test_op2_long_runs(spark):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    full = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, added=True)
    for text in (" " * 3_000_000, "a" * 100_000, "x " + "\n" * 1_200_000 + " y", "word " * 9000):
        assert encode(text) == full.encode(text, add_special_tokens=False).ids


def test_pipeline_personal_data_with_clashing_names(spark):
    import corpus_pipeline

    names = "doc_id bigint, text string, n_chars int, h_spans string, h_doc int, h_row int, d_doc int, d_row int, row string"
    docs_ = spark.createDataFrame([(1, "mail a@b.co now", 15, "s", 1, 2, 3, 4, "r"), (None, None, None, "s", 1, 2, 3, 4, "r"), (2, "plain", 5, "s", 1, 2, 3, 4, "r")], names)
    got = corpus_pipeline.personal_data_redaction(spark, docs_, SF)
    assert got.columns == docs_.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [*docs_.filter("doc_id is null or doc_id = 2").collect(), docs_.first().__class__(**{**docs_.filter("doc_id = 1").first().asDict(), "text": "mail [EMAIL] now", "n_chars": 16})]))


def _licence_texts():
    """(expected licences, text): every wording and notice wrapped, unwrapped and as a comment block."""
    texts = [("MIT", "The MIT License\n\nCopyright (c) 2020 A. Person\n\n" + WORDINGS["MIT"])]
    texts += [(name, "Some code\n\n" + words) for name, words in WORDINGS.items()]
    for code, form, version, end in (("GPL-3.0-or-later", "General Public License", "3", ", or\n(at your option) any later version."), ("LGPL-2.1-or-later", "Lesser General Public License", "2.1", ", or\n(at your option) any later version.")):
        texts.append((code, f"Foo is free software: you can redistribute it and/or modify\nit under the terms of the GNU {form} as published by\nthe Free Software Foundation, either version {version} of the License{end}\n\n"
                      f"This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {form} for more details.\n"))
    texts.append(("Apache-2.0", 'Copyright 2020 A\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required'))
    out = []
    for name, text in texts:
        paragraphs = [" ".join(x.split()) for x in text.split("\n\n")]
        out += [(name, text), (name, "\n\n".join(paragraphs)), (name, "\n".join(f" * {x}" for x in text.split("\n"))), (name, text.replace("\n", "\r\n"))]
    return out


_LICENCE_ROWS = [
    ("Apache-2.0,MIT", "Intro. Licensed under the Apache License, Version 2.0.\nReleased under the MIT License. x"), ("", None), ("", ""), ("", "?!\n\n.\n"),
    ("CC-BY-NC-4.0", "a line\nLicensed under CC BY-NC 4.0\nanother"), ("GPL-3.0", "x. This work is licensed under the GNU General Public License version 3."),
    ("MPL-2.0", "/* SPDX-License-Identifier: MPL-2.0 */"), ("Proprietary", "Copyright X. All rights reserved."), ("MIT", "All rights reserved.\n\nReleased under the MIT license."),
    ("", "you can obtain the MIT license elsewhere"), ("", "." * 300_000 + "x" + "\n-" * 100_000 + '."' * 100_000 + "word " * 50_000),
]


def test_op4_licences_wrapped_and_unwrapped(spark):
    import duckdb

    cases = _licence_texts() + _LICENCE_ROWS
    rows = spark.createDataFrame([(k, t, "x", 1) for k, (_, t) in enumerate(cases + cases[:1])], "doc_id bigint, text string, plain string, ids int")
    got = sorted(map(tuple, scan(rows).collect()))
    assert [r[3] for r in got] == [name for name, _ in cases + cases[:1]]
    con = duckdb.connect()
    con.register("documents", rows.toPandas())
    assert sorted(con.execute(Q.ORACLE_SQL["op4_license_sentence_rules"]).fetchall()) == got
    assert scan(rows.limit(0)).count() == 0


def test_op4_every_rule_can_match(spark):
    """Each rule's identifiers come from some sentence, so none is dead."""
    names = set(SENTENCES.values()) | {name for _, _, name in SLOTS}
    assert all(set(rule.split()) <= names for _, rule in RULES)
    assert all(short_sentences(s) == [s] or s.startswith("under ") for s in SENTENCES)


def test_op4_sql(spark, docs):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(Q.ORACLE_SQL["op4_license_sentence_rules"]).fetchall())
    assert sorted(map(tuple, Q.QUERIES["op4_license_sentence_rules"](spark, SF).collect())) == want
    assert scan(docs).count() == len(ROWS)


def test_op1_edited_and_fingerprints(spark, docs, small):
    got = {r.doc_id: r for r in Q.QUERIES["op1_spotsigs"](spark, SF).collect()}
    order = sorted(small, reverse=True)
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1
    prints = collections.defaultdict(set)
    for r in fingerprints(docs).collect():
        prints[r.text].add(tuple(r.signatures))
    assert all(len(x) == 1 for x in prints.values()) and prints[""] == {()}


def test_op1_similar(spark):
    base = [f"the {a} {b}" for a, b in zip("abcdefghij", "klmnopqrst")]
    rows = [(1, " ".join(base)), (2, " ".join(base[:9] + ["the zz yy"])), (3, "the other words of it"), (4, " ".join(base))]
    got = [(r.a, r.b) for r in similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert got == [(1, 2)]


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = p.language_id(spark, docs, "/root/testdata/sf0.01")
    assert lang.columns == docs.columns and lang.count() == docs.count()
    extra = docs.limit(60).union(docs.limit(60))
    assert p.near_dedup(spark, extra, "").count() <= 60
    red = p.personal_data_redaction(spark, docs, "").collect()
    assert not any(re.search(r"@mail[0-9]\.example\.com", r.text or "") for r in red)
