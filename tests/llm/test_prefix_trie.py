"""The prefix trie against one built in plain Python, for any number of shards."""

import hashlib
import random
import zlib

import pytest

from carrylens.llm import op13_prefix_trie as P
from carrylens.llm.op13_prefix_trie import Skeleton, forked, op13_splitter_skeleton_trie, paths_of, prefix_trie

SF = "/root/testdata/sf0.001"


def spelled(rows):
    """conv_id -> [(role, text)] in turn order."""
    out = {}
    for c, t, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16], role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def by_hand(convs):
    nodes, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        kids.setdefault(p, 0)
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            up = p[:-1]
            kids[up], leaves[up], saved[up] = kids.get(up, 0) + 1, leaves.get(up, 0) + leaves[p], saved.get(up, 0) + saved[p]
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in nodes.items())


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def test_query_is_brute_force_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = by_hand(rebuilt(spelled(rows)))
    assert got(op13_splitter_skeleton_trie(spark, SF)) == want
    assert any(r[3] > 1 and r[1] for r in want)


EDGES = [
    (0, 0, "user", "héllo 🙂"), (0, None, None, "first"), (0, 1, "a", None), (0, 1, "a", None), (0, 2, "b", "c"), (0, 3, "b", "d"), (0, 9, "b", "last"),
    (None, 0, "user", "nobody"), (7, 0, "user", "x"), (101, 0, "us", "erx"), (102, 0, "user", "x"), (103, 5, "user", "x"), (300, 0, "", ""), (200, 0, "user", "x"), (201, 0, "user", "x"), (201, 1, "user", "y"),
    *[(c, t, "user", f"copy {t}") for c in range(400, 460) for t in range(3)],
    *[(c, t, "user", f"copy {t}") for c in range(500, 520) for t in range(5)],
    *[(900, t, "user", f"long {t % 7}") for t in range(700)], *[(901, t, "user", f"long {t % 7}") for t in range(690)],
]


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_edges_for_any_number_of_shards(spark, monkeypatch, shards):
    monkeypatch.setattr(P, "PIECE", 7)
    rows = EDGES[:]
    random.Random(shards).shuffle(rows)
    table = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, path string, at int")
    convs = spelled(rows)
    assert got(prefix_trie(paths_of(table), shards)) == by_hand(convs)
    assert got(prefix_trie(forked(paths_of(table)), shards)) == by_hand(rebuilt(convs))


@pytest.mark.parametrize("seed", range(3))
def test_random_tries_in_tasks(seed, monkeypatch):
    """Shards and reduction without Spark: any splitters give the same trie."""
    monkeypatch.setattr(P, "CUT", 3)
    draw = random.Random(seed)
    convs = {c: [("u", "abc"[draw.randrange(3)] * draw.randrange(1, 3)) for _ in range(draw.choice([0, 1, 2, 3, 5]))] for c in range(200)}
    rows = sorted((b"".join(hashlib.md5(repr(t).encode()).digest() for t in turns), c, [len(t[1]) for t in turns]) for c, turns in convs.items())
    trie = Skeleton(draw.sample(rows, 12))
    out, shard = [], None
    for path, c, chars in rows:
        number = trie.shard(path, c)
        if shard is None or shard.number != number:
            if shard:
                shard.end()
            shard = P._Shard(trie, number, out)
        shard.add(path, c, chars)
    shard.end()
    total = {}
    for r in out:
        if r[0] == "part":
            x = total.setdefault(r[1:3], [r[3], 0, 0, 0, 0])
            x[0], x[1:] = min(x[0], r[3]), [a + b for a, b in zip(x[1:], r[5:9])]
    bones = {(at, d): (up, within, own) for at, d, up, within, own in trie.nodes()}
    assert set(bones) == set(total)
    nodes = [(t[0], k[1], total[bones[k][0], k[1] - 1][0] if k[1] else -1, t[1], t[2] + bones[k][1], t[3], t[4] - bones[k][2]) for k, t in total.items()]
    nodes += [(r[3], r[2], r[4] if r[1] is None else total[r[1], r[2] - 1][0], *r[5:9]) for r in out if r[0] == "node"]
    assert sorted(nodes) == [r[:-1] for r in by_hand(convs)]


def test_empty_table(spark):
    assert prefix_trie(paths_of(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).collect() == []
