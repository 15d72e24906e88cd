"""SimHash by ball hashing against brute force and on edge cases."""

import re

import pytest
import xxhash

from carrylens.llm.op12_simhash import ball_links, fingerprint, masks, near_duplicates, op12_simhash_ball

SF = "/root/testdata/sf0.001"


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def least(n, links):
    """The least member of each node's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_query_is_brute_force_on_the_whole_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [by_hand(t) for _, t in rows]
    assert [i for i, _ in rows] == list(range(len(rows)))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = [(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, least(len(rows), links)))]
    assert sorted(map(tuple, op12_simhash_ball(spark, SF).collect())) == want
    assert any(i != c for i, _, c in want)


def test_long_texts_and_case():
    text = " ".join(f"Word{i % 977}" for i in range(70_000)) + " ÀB É"
    assert fingerprint(text) & (1 << 64) - 1 == by_hand(text)
    assert fingerprint("ONE two") == fingerprint("one\x0btwo\n")
    assert fingerprint("a b") != fingerprint("a b")


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_chains_connect_what_pairs_connect(spark, radius):
    # a dense family: every variant of one fingerprint, and chains that leave it two bits at a time
    values = {7, *(7 ^ m for m in masks(1)), *(7 ^ (2 << k) - 1 << 3 for k in range(1, 50, 2)), 1 << 40, (1 << 40) + 0b111, -1, -8}
    values = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in values)
    found = ball_links(spark.createDataFrame([(v,) for v in values], "fp bigint"), radius).collect()
    place = {v: i for i, v in enumerate(values)}
    near = [(a, b) for a in range(len(values)) for b in range(a) if ((values[a] ^ values[b]) & (1 << 64) - 1).bit_count() <= radius]
    links = [(place[r.fp_a], place[r.fp_b]) for r in found]
    assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in near}
    assert least(len(values), links) == least(len(values), near)
    assert len(links) == len(set(links))


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        ball_links(spark.createDataFrame([(1,)], "fp bigint"), 3)


def test_edge_rows(spark):
    rows = [(9, None), (4, ""), (7, " \t"), (None, "x y z"), (12, "x y z"), (5, "x y z w v"), (5, "q r s t u"), (6, "q r s t u"), (8, "x y z w v"), (8, "x y z w v"), (30, "alone here")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "v", 4) for i, t in rows], "doc_id bigint, text string, fp int, class_id int, component_id int, variant string, a int")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    want = [(9, 4), (4, 4), (7, 4), (None, None), (12, 12), (5, 5), (5, 5), (6, 5), (8, 5), (8, 5), (30, 30)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
