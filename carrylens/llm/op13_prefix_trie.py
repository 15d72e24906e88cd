"""The prefix trie of conversations by a splitter-skeleton.

A conversation is a path of turn names (16 bytes of a digest of role and
text).  Paths with their conv_id are range-partitioned at splitters, which are
paths themselves.  A node whose members lie in more than one shard is a prefix
of a splitter next to it, so the trie of the splitters (the skeleton) holds all
such nodes.  It is broadcast; each sorted shard finishes every other node in
one pass over its paths with a stack of open nodes, and adds what it knows of
skeleton nodes as partial aggregates, which are reduced by their node.

Additive parts: members, least member, children and leaves outside the
skeleton.  A skeleton node is a leaf if the last shard that it reaches into
sees no child.  ``saved`` adds members times code points per shard; the one
copy to keep of each node is taken off by the skeleton, which knows its turns.

Scale: splitters come from a bounded sample (``SAMPLES`` a shard; it decides
only where shards end, no result) and include the conv_id, so copies of one
conversation, or of one first turn, are dealt over as many shards as their
share asks for.  The skeleton has at most ``CUT`` nodes a shard: of a longer
splitter only the first CUT turns count.  Texts never move, only names (16
bytes a turn) and lengths; one conversation is one row of these.  A task holds
the open path and the finished children of its open nodes.  The ids that end
at a skeleton node are hashed in order from pieces of ``PIECE`` ids, one piece
held at a time (SHA-256 has one state, so one node's ids pass through one
task, as text and not as rows).

Edge cases: a null conv_id takes no part; null role or text is empty; a null
turn comes first; turns with one number are ordered by their name, so repeated
rows are repeated turns; a conversation without turns is a member of the root
alone; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrylens.llm.common import table, written

NAME = 16  # bytes of a turn's name
CUT = 256  # turns of a splitter that count
SAMPLES = 20  # sampled paths a shard
PIECE = 1 << 15  # ids in a piece of a skeleton node's ends
FORK, HEAD = 100, 6  # of the query: conversations that share a start, and how many lengths it has


def paths_of(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> (conv_id, turns): an array of (turn, name, chars) in order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    spelled = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    name = F.unhex(F.substring(F.sha2(spelled, 256), 1, 2 * NAME))
    turn = F.struct("turn", name.alias("name"), F.length(text).cast("bigint").alias("chars"))
    return conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def forked(paths: DataFrame) -> DataFrame:
    """Every conversation c starts with the first turns of c - c % 100, as many as crc32(c) % 6 says, and goes on with its own."""
    heads = paths.filter(F.col("conv_id") % FORK == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD - 1).alias("head"))
    n = F.crc32(F.col("conv_id").cast("string")) % HEAD
    own = paths.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FORK, "n": n.cast("int")})
    start = F.coalesce(F.slice("head", F.lit(1), F.col("n")), F.slice("turns", 1, 0))
    return own.join(heads, "base", "left").select("conv_id", F.concat(start, F.expr("slice(turns, n + 1, size(turns))")).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """How many first turns two paths share."""
    low, high = 0, min(len(a), len(b)) // NAME
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * NAME : mid * NAME] == b[low * NAME : mid * NAME]:
            low = mid
        else:
            high = mid - 1
    return low


class Skeleton:
    """The trie of the splitters: sorted (path, conv_id) with the code points of
    each turn.  A node's key is (first splitter that has it, depth)."""

    def __init__(self, splitters: list[tuple[bytes, int, list[int]]]) -> None:
        cut = [(p, i, c) if len(p) <= CUT * NAME else (p[: CUT * NAME], -(1 << 63), c[:CUT]) for p, i, c in splitters]
        cut = sorted({x[:2]: x for x in cut}.values())
        self.keys, self.chars = [x[:2] for x in cut], [x[2] for x in cut]
        self.first: list[list[int]] = []
        for j, (path, _) in enumerate(self.keys):
            same = shared(self.keys[j - 1][0], path) if j else -1
            self.first.append([self.first[j - 1][d] if d <= same else j for d in range(len(path) // NAME + 1)])

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.keys, (path, conv_id))

    def border(self, j: int) -> bytes | None:
        return self.keys[j][0] if 0 <= j < len(self.keys) else None

    def nodes(self) -> list[tuple[int, int, int | None, int, int]]:
        """(at, depth, at of the parent, children in the skeleton, code points of all turns of the subtree)."""
        found = {(0, 0): (None, 0)} | {(at, d): (self.first[at][d - 1], self.chars[at][d - 1]) for firsts in self.first for d, at in enumerate(firsts) if d}
        kids, total = dict.fromkeys(found, 0), {k: chars for k, (_, chars) in found.items()}
        for at, d in sorted(found, key=lambda k: -k[1]):
            if d:
                above = (found[at, d][0], d - 1)
                kids[above] += 1
                total[above] += total[at, d]
        return [(at, d, parent, kids[at, d], total[at, d]) for (at, d), (parent, _) in found.items()]


class _Node:
    """An open node of the path that a shard is at."""

    __slots__ = ("chars", "depth", "ends", "kids", "least", "leaves", "n", "piece", "rows", "saved", "seen", "skeleton", "text")

    def __init__(self, depth: int, chars: int, skeleton: int | None) -> None:
        self.depth, self.chars, self.skeleton = depth, chars, skeleton
        self.least, self.n, self.kids, self.leaves, self.saved, self.seen = None, 0, 0, 0, 0, False
        self.rows: list[tuple] = []  # finished children, until the least member is known
        self.ends, self.text, self.piece = None, [], 0


_COLUMNS = ["kind", "at", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "shard", "piece"]
_SCHEMA = "kind string, at bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, shard bigint, piece bigint"
_TYPES = [pa.string(), *[pa.int64()] * 8, pa.string(), pa.int64(), pa.int64()]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


class _Shard:
    """One pass over a shard's sorted paths; ``out`` gathers rows of _COLUMNS:
    finished nodes ('node'; ``at`` names a parent in the skeleton), partial
    aggregates ('part') and pieces of ends ('ends') of skeleton nodes."""

    def __init__(self, skeleton: Skeleton, number: int, out: list[tuple]) -> None:
        self.skeleton, self.number, self.out = skeleton, number, out
        self.left, self.right = skeleton.border(number - 1), skeleton.border(number)
        self.path = b""
        self.open = [_Node(0, 0, 0)]

    def add(self, path: bytes, conv_id: int, chars: list[int]) -> None:
        while len(self.open) > 1 + shared(self.path, path):
            self.close()
        left = -1 if self.left is None else shared(self.left, path)
        right = -1 if self.right is None else shared(self.right, path)
        for d in range(len(self.open), len(path) // NAME + 1):
            at = self.skeleton.first[self.number - 1][d] if d <= left else self.skeleton.first[self.number][d] if d <= right else None
            self.open.append(_Node(d, chars[d - 1], at))
        self.path = path
        node = self.open[-1]
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if node.skeleton is None:
            if node.ends is None:
                node.ends = hashlib.sha256(str(conv_id).encode())
            else:
                node.ends.update(f",{conv_id}".encode())
        else:
            node.text.append(str(conv_id))
            if len(node.text) == PIECE:
                self.flush(node)

    def flush(self, node: _Node) -> None:
        if node.text:
            self.out.append(("ends", node.skeleton, node.depth, *[None] * 6, ",".join(node.text), self.number, node.piece))
            node.text, node.piece = [], node.piece + 1

    def close(self) -> None:
        node = self.open.pop()
        above = self.open[-1] if self.open else None
        # a skeleton node that the right border has goes on in the next shard
        goes_on = node.skeleton is not None and self.right is not None and shared(self.right, self.path) >= node.depth
        node.leaves += not node.seen and not goes_on
        node.saved += node.chars * (node.n - (node.skeleton is None))
        for row in node.rows:
            self.out.append(("node", None, row[0], row[1], node.least, *row[2:], None, None))
        if node.skeleton is not None:
            self.flush(node)
            self.out.append(("part", node.skeleton, node.depth, node.least, None, node.n, node.kids, node.leaves, node.saved, None, self.number, None))
        else:
            row = (node.depth, node.least, node.n, node.kids, node.leaves, node.saved, node.ends.hexdigest() if node.ends else _NO_ENDS)
            above.kids += 1
            if above.skeleton is None:
                above.rows.append(row)
            else:
                self.out.append(("node", above.skeleton, row[0], row[1], None, *row[2:], None, None))
        if above is not None:
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.leaves, above.saved, above.seen = above.leaves + node.leaves, above.saved + node.saved, True

    def end(self) -> None:
        while self.open:
            self.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _COLUMNS)


def _dealer(skeleton):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = skeleton.value
        for b in batches:
            shards = [trie.shard(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist())]
            yield b.append_column("shard", pa.array(shards, pa.int32()))

    return deal


def _finisher(skeleton):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, shard, out = skeleton.value, None, []
        for b in batches:
            for number, path, conv_id, chars in zip(*(b.column(c).to_pylist() for c in ("shard", "path", "conv_id", "chars"))):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.end()
                    shard = _Shard(trie, number, out)
                shard.add(path, conv_id, chars)
            yield _batch(out)
            out.clear()
        if shard is not None:
            shard.end()
            yield _batch(out)

    return finish


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (at, depth, shard, piece) -> one digest a node."""
    key = state = None

    def row(rows: list) -> pa.RecordBatch:
        cols = zip(*rows) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], ["at", "depth", "digest"])

    for b in batches:
        done = []
        for at, depth, text in zip(*(b.column(c).to_pylist() for c in ("at", "depth", "ends"))):
            if (at, depth) == key:
                state.update(b"," + text.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (at, depth), hashlib.sha256(text.encode())
        yield row(done)
    if key is not None:
        yield row([(*key, state.hexdigest())])


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """(conv_id, turns) -> one row per node: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), ""))
    paths = written(paths.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "paths")
    # a bounded sample, by a hash of the id: at most SAMPLES paths a shard, cut to the turns that count
    cut = paths.select(F.substring("path", 1, (CUT + 1) * NAME).alias("path"), "conv_id", F.slice("chars", 1, CUT + 1).alias("chars"))
    sample = sorted(map(tuple, cut.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLES * shards).collect()), key=lambda r: (bytes(r[0]), r[1]))
    picked = [sample[len(sample) * k // shards] for k in range(1, shards)] if sample else []
    trie = Skeleton([(bytes(p), i, list(c)) for p, i, c in picked])
    skeleton = spark.sparkContext.broadcast(trie)
    dealt = paths.mapInArrow(_dealer(skeleton), "conv_id bigint, path binary, chars array<bigint>, shard int")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    rows = written(dealt.mapInArrow(_finisher(skeleton), _SCHEMA), "trie")

    bones = spark.createDataFrame(trie.nodes(), "at bigint, depth bigint, parent bigint, within bigint, own bigint")
    parts = rows.filter("kind = 'part'").groupBy("at", "depth").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    ends = (rows.filter("kind = 'ends'").select("at", "depth", "shard", "piece", "ends").repartition("at", "depth")
            .sortWithinPartitions("at", "depth", "shard", "piece").mapInArrow(_digest, "at bigint, depth bigint, digest string"))
    bones = written(parts.join(bones, ["at", "depth"]).join(ends, ["at", "depth"], "left").select(
        "at", "depth", "parent", "conv_id", "n_convs", (F.col("n_children") + F.col("within")).alias("n_children"), "n_leaves",
        (F.col("saved_tokens") - F.col("own")).alias("saved_tokens"), F.coalesce("digest", F.lit(_NO_ENDS)).alias("ends_sha256")), "skeleton")
    # at most CUT nodes a shard
    above = F.broadcast(bones.select(F.col("at").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = rows.filter("kind = 'node'").withColumnRenamed("ends", "ends_sha256")
    tops = nodes.filter("at is not null").drop("parent_conv_id").withColumnRenamed("at", "parent").join(above, ["parent", "depth"])
    return nodes.filter("at is null").select(columns).union(tops.select(columns)).union(bones.join(above, ["parent", "depth"], "left").select(columns))


def op13_splitter_skeleton_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(forked(paths_of(table(spark, sf_dir, "conversations"))))
