"""Hard negatives by cover trees over norm-augmented candidates.

With ``M`` the greatest norm, a candidate x gets one more coordinate
``sqrt(M**2 - |x|**2)`` and a query a zero there; then
``distance**2 = M**2 + |q|**2 - 2 x.q``, so a covering radius around a node's
centre bounds the inner products of everything below it from both sides.
Queries ask for the best ``k`` rows of a label, or of all others, in windows of
the score.  A best-first descent takes the node with the greatest upper bound,
skips nodes whose bounds lie outside every window (or under its k-th score) and
verifies leaves by exact integer products.

The tree has its top levels on the driver (at most ``PIVOTS`` centres, chosen
greedily by halved radii on a bounded sample of ``SAMPLE`` rows) and the rest
in blocks of about ``BLOCK`` candidates, one tree per label.  Every row is
indexed and all radii are measured on all rows, so the sample decides only how
well the bounds prune; results are exact.  Blocks are written once as rows and
joined with the queries whose windows reach them: first the nearest pivot's,
then, with the k-th scores found there, the others that may still hold better.

Scale: candidates with equal label and vector are one candidate with its k + 1
least ids (ties go to the least ids, so no other can ever be returned), and
equal queries are one query; a vector that a third of all rows share costs one
row, cut before the shuffle.  Large pivots are dealt over salted blocks and
queries over portions of ``PORTION``, each with a copy of the block.  In many
dimensions without clusters the bounds prune little and the work comes near
that of comparing all queries with all rows, in blocks.

Edge cases: rows with a null id, label or vector, or a null or non-finite
component take no part, nor do those whose scaled vector is 2**30 or longer
(their products may not fit a long); of rows with one id the least by label and
vector counts; a shorter vector ends in zeros; an anchor without rows of its
label, or without rows in a window, has no result there; an empty table has no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carrylens.llm.common import table, written

SCALE = 256  # a component x counts as floor(SCALE * x)
EVERY = 100  # anchors' ids are divisible by this
PER_ANCHOR, PER_PAIR = 5, 5  # positives an anchor, negatives a pair
LOW = 80  # per cent of the positive score that a negative must reach
BLOCK = 4096  # candidates in a block
PIVOTS, SAMPLE = 1024, 2048
PORTION = 20_000  # queries that share one copy of a block
LEAF = 24  # members of a node that isn't split
_FAR = 1 << 62


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) -> (id, label, v): scaled integer vectors, one row an id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = whole.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (SCALE * x) * (SCALE * x))
    whole = whole.filter(squares < float(1 << 60)).select("id", "label", F.transform("embedding", lambda x: F.floor(SCALE * x).cast("bigint")).alias("v"))
    return whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix of int64, shorter rows filled with zeros."""
    lists = column.to_pylist()
    out = np.zeros((len(lists), dim), dtype=np.int64)
    for row, v in zip(out, lists):
        row[: len(v)] = v
    return out


def product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products; float64 gives them exactly where all of them stay under 2**53."""
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if exact else a @ b


class Space:
    """What bounds need: the greatest squared norm, the dimension, the pivots and their radii."""

    def __init__(self, dim: int, most: int) -> None:
        self.dim, self.most, self.exact = dim, most, most < 1 << 52
        self.pivots = self.radii = self.blocks = None

    def augmented(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.column_stack((v, np.sqrt(np.maximum(0, self.most - (v * v).sum(axis=1)))))

    def bounds(self, dots: np.ndarray, norm: float, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of the products below centres with these products and radii."""
        total = self.most + norm
        distance = np.sqrt(np.maximum(0, total - 2 * dots.astype(np.float64)))
        slack = 1e-9 * total + 0.5
        return (total - (distance + radii) ** 2) / 2 - slack, (total - np.maximum(0, distance - radii) ** 2) / 2 + slack


def greedy_cover(points: np.ndarray, wanted: int) -> np.ndarray:
    """The top of a cover tree: places of at most ``wanted`` centres, level by
    level with halved radii; every level keeps the centres above it."""
    centres = [0]
    distance = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    radius = distance.max(initial=0.0)
    while len(centres) < wanted and radius > 0 and distance.max() > 0:
        radius /= 2
        while len(centres) < wanted and (far := np.flatnonzero(distance > radius)).size:
            centres.append(int(far[0]))
            distance = np.minimum(distance, np.sqrt(((points - points[far[0]]) ** 2).sum(axis=1)))
    return np.array(centres)


class CoverTree:
    """Candidates of one label: ``order`` lists them so that a node's members
    are neighbours; nodes have a centre, a covering radius, members and children."""

    PARTS = ("order", "centre", "radius", "lo", "hi", "first", "end")

    def __init__(self, points: np.ndarray) -> None:
        nodes: list[list] = []  # centre, radius, first member, end, first child, end
        self.order = np.arange(len(points))
        work = [(self._node(nodes, points, 0, 0, len(points)))]
        while work:
            at = work.pop()
            centre, radius, lo, hi = nodes[at][:4]
            if hi - lo <= LEAF or radius == 0:
                continue
            nodes[at][4] = len(nodes)
            left, start, first = self.order[lo:hi].copy(), lo, centre
            while left.size:  # each child covers half the radius around the first member that no other child has
                near = np.sqrt(((points[left] - points[first]) ** 2).sum(axis=1)) <= radius / 2
                near[left == first] = True
                self.order[start : (end := start + int(near.sum()))] = left[near]
                self._node(nodes, points, first, start, end)
                left, start = left[~near], end
                first = left[0] if left.size else None
            nodes[at][5] = len(nodes)
            work.extend(range(nodes[at][4], nodes[at][5]))
        self.centre, self.lo, self.hi, self.first, self.end = (np.array([n[k] for n in nodes]) for k in (0, 2, 3, 4, 5))
        self.radius = np.array([n[1] for n in nodes])

    def _node(self, nodes: list, points: np.ndarray, centre: int, lo: int, hi: int) -> int:
        away = points[self.order[lo:hi]] - points[centre]
        nodes.append([centre, float(np.sqrt((away * away).sum(axis=1)).max()), lo, hi, 0, 0])
        return len(nodes) - 1


class Block:
    """The candidates of a block with a tree for each label."""

    def __init__(self, space: Space, labels: np.ndarray, vectors: np.ndarray, ids: list[list[int]]) -> None:
        order = np.lexsort((np.array([x[0] for x in ids]), labels))
        self.vectors, self.ids, self.trees = vectors[order], [ids[k] for k in order], {}
        labels, points = labels[order], space.augmented(vectors[order])
        for label in np.unique(labels):
            lo, hi = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
            self.trees[int(label)] = (int(lo), CoverTree(points[lo:hi]))

    def dump(self) -> bytes:
        """Plain arrays only, so that tasks need no class by its module's name."""
        trees = {name: (offset, [getattr(tree, part) for part in CoverTree.PARTS]) for name, (offset, tree) in self.trees.items()}
        return pickle.dumps((self.vectors, self.ids, trees), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> Block:
        block = cls.__new__(cls)
        block.vectors, block.ids, trees = pickle.loads(data)
        block.trees = {}
        for name, (offset, parts) in trees.items():
            tree = CoverTree.__new__(CoverTree)
            tree.__dict__.update(zip(CoverTree.PARTS, parts))
            block.trees[name] = (offset, tree)
        return block

    def search(self, space: Space, query: np.ndarray, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (lo, hi) its best k as (-score, id), of the label or of all others."""
        norm = float((query.astype(np.float64) ** 2).sum())
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        least = [lo for lo, _ in windows]
        heap: list[tuple[float, int, int]] = []

        def needed(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            out = np.zeros(len(lower), dtype=bool)
            for low, (_, hi) in zip(least, windows):
                out |= (upper >= low) & (lower <= hi)
            return out

        def verify(places: np.ndarray, scores: np.ndarray) -> None:
            for w, (_, hi) in enumerate(windows):
                for p in np.flatnonzero((scores >= least[w]) & (scores <= hi)).tolist():
                    score = int(scores[p])
                    if score >= least[w]:
                        found[w] = heapq.nsmallest(k, found[w] + [(-score, i) for i in self.ids[places[p]]])
                        if len(found[w]) == k:
                            least[w] = max(least[w], -found[w][-1][0])

        def visit(name: int, nodes: np.ndarray) -> None:
            offset, tree = self.trees[name]
            centres = tree.centre[nodes] + offset
            dots = product(self.vectors[centres], query, space.exact)
            lower, upper = space.bounds(dots, norm, tree.radius[nodes])
            alone = tree.hi[nodes] - tree.lo[nodes] == 1  # the centre's product is the member's
            verify(centres[alone], dots[alone])
            for p in np.flatnonzero(needed(lower, upper) & ~alone).tolist():
                heapq.heappush(heap, (-float(upper[p]), -float(lower[p]), name, int(nodes[p])))

        for name in self.trees:
            if (name == label) == same:
                visit(name, np.zeros(1, dtype=np.int64))
        while heap:
            upper, lower, name, node = heapq.heappop(heap)
            if not any(-upper >= low and -lower <= hi for low, (_, hi) in zip(least, windows)):
                continue
            offset, tree = self.trees[name]
            if tree.end[node] > tree.first[node]:
                visit(name, np.arange(tree.first[node], tree.end[node]))
            else:
                places = tree.order[tree.lo[node] : tree.hi[node]] + offset
                verify(places, product(self.vectors[places], query, space.exact))
        return found


def _assigner(space):
    """Adds each candidate's nearest pivot and its distance."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for b in batches:
            points, pivot, distance = s.augmented(matrix(b.column("v"), s.dim)), np.zeros(b.num_rows, np.int32), np.full(b.num_rows, np.inf)
            for j, p in enumerate(s.pivots):
                away = np.sqrt(((points - p) ** 2).sum(axis=1))
                pivot[away < distance] = j
                distance = np.minimum(distance, away)
            yield b.append_column("pivot", pa.array(pivot)).append_column("distance", pa.array(distance))

    return assign


_INDEX = "pivot int, salt int, tree binary"


def _builder(space):
    """Candidates sorted by (pivot, salt) -> a row per block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, key, labels, vectors, ids = space.value, None, [], [], []

        def block() -> pa.RecordBatch:
            tree = Block(s, np.concatenate(labels), np.concatenate(vectors), [x for part in ids for x in part]).dump()
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([tree], pa.binary())], ["pivot", "salt", "tree"])

        for b in batches:
            keys = list(zip(b.column("pivot").to_pylist(), b.column("salt").to_pylist()))
            cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo] != key:
                    if key is not None:
                        yield block()
                    key, labels, vectors, ids = keys[lo], [], [], []
                part = b.slice(lo, hi - lo)
                labels.append(np.array(part.column("label").to_pylist(), dtype=np.int64))
                vectors.append(matrix(part.column("v"), s.dim))
                ids.append(part.column("ids").to_pylist())
        if key is not None:
            yield block()

    return build


class Index:
    """Blocks of trees as a table, and what the driver knows of them (bounded by PIVOTS)."""

    def __init__(self, candidates: DataFrame) -> None:
        """candidates: (label, v, ids), distinct by label and vector."""
        spark = candidates.sparkSession
        squares = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x * x)
        n, most, dim = candidates.agg(F.count("*"), F.max(squares), F.max(F.size("v"))).first()
        self.space = Space(dim or 0, most or 0)
        if n:
            sample = candidates.orderBy(F.xxhash64("label", "v"), F.col("ids")[0]).select("v").limit(SAMPLE).toArrow()
            points = self.space.augmented(matrix(sample.column("v"), self.space.dim))
            self.space.pivots = points[greedy_cover(points, min(PIVOTS, -(-n // BLOCK)))]
        else:
            self.space.pivots = np.zeros((0, self.space.dim + 1))
        named = candidates.mapInArrow(_assigner(spark.sparkContext.broadcast(self.space)), "label bigint, v array<bigint>, ids array<bigint>, pivot int, distance double")
        named = written(named, "candidates")
        sizes = {r.pivot: (r.n, r.radius) for r in named.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
        of = [sizes.get(j, (0, 0.0)) for j in range(len(self.space.pivots))]
        self.space.radii, self.space.blocks = np.array([r for _, r in of]), np.array([-(-c // BLOCK) for c, _ in of], dtype=np.int64)
        self.shared = spark.sparkContext.broadcast(self.space)
        parts = F.element_at(F.array(*(F.lit(int(x)) for x in self.space.blocks), F.lit(1)), F.col("pivot") + 1)
        salted = named.withColumn("salt", F.pmod(F.xxhash64(F.col("ids")[0]), parts).cast("int")).drop("distance")
        built = salted.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt").mapInArrow(_builder(self.shared), _INDEX)
        self.blocks = written(built, "blocks")

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """queries (qid, label, v, windows: array of (lo, hi)) -> (qid, lo, hi, score, id):
        the best k of each window, of the query's label or of all others."""
        queries = written(queries, "queries")
        nearest = written(self._round(queries, same, k, True), "nearest")
        kth = (nearest.groupBy("qid", "hi").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
               .groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("hi", "kth"))).alias("kth")))
        # of other pivots only what reaches the k-th score may still count
        floors = queries.join(kth, "qid", "left")
        rest = written(self._round(floors, same, k, False), "rest")
        best = W.partitionBy("qid", "hi").orderBy(F.desc("score"), "id")
        return nearest.union(rest).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place")

    def _round(self, queries: DataFrame, same: bool, k: int, nearest: bool) -> DataFrame:
        if "kth" not in queries.columns:
            queries = queries.withColumn("kth", F.lit(None).cast("map<bigint,bigint>"))
        portions = max(1, -(-queries.count() // PORTION))
        # a window's floor rises to the k-th score found so far
        lists = [F.transform("windows", lambda w: F.greatest(w["lo"], F.coalesce(F.try_element_at("kth", w["hi"]), w["lo"]))).alias("floors"), F.transform("windows", lambda w: w["hi"]).alias("his")]
        asked = queries.select("qid", "label", "v", *lists).mapInArrow(_router(self.shared, nearest), _ASKED)
        asked = asked.withColumn("portion", F.pmod(F.xxhash64("qid"), F.lit(portions)).cast("int")).withColumn("tree", F.lit(None).cast("binary"))
        needed = asked.select("pivot", "salt", "portion").distinct()
        blocks = self.blocks.join(needed, ["pivot", "salt"]).select(*(F.lit(None).cast(t).alias(c) for c, t in _QUERY), "pivot", "salt", "portion", "tree")
        rows = blocks.unionByName(asked).repartition("pivot", "salt", "portion").sortWithinPartitions("pivot", "salt", "portion", F.col("tree").isNull(), "qid")
        return rows.mapInArrow(_searcher(self.shared, same, k), "qid bigint, lo bigint, hi bigint, score bigint, id bigint")


_QUERY = (("qid", "bigint"), ("label", "bigint"), ("v", "array<bigint>"), ("floors", "array<bigint>"), ("his", "array<bigint>"))
_ASKED = ", ".join(f"{c} {t}" for c, t in _QUERY) + ", pivot int, salt int"


def _router(space, nearest: bool):
    """A row per query and block that it has to visit: those of the nearest
    pivot, or those of the others whose bounds reach a window."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for b in batches:
            queries, rows, pivots, salts = matrix(b.column("v"), s.dim).astype(np.float64), [], [], []
            for at, (q, floors, his) in enumerate(zip(queries, b.column("floors").to_pylist(), b.column("his").to_pylist())):
                if not len(s.pivots):
                    continue
                norm, dots = float(q @ q), s.pivots[:, :-1] @ q
                home = int(np.argmax(dots))  # the augmented query is nearest to the greatest product
                lower, upper = s.bounds(dots, norm, s.radii)
                take = np.zeros(len(dots), dtype=bool)
                for lo, hi in zip(floors, his):
                    take |= (upper >= lo) & (lower <= hi) & (lo <= hi)
                take &= (np.arange(len(dots)) == home) == nearest
                for j in np.flatnonzero(take).tolist():
                    for salt in range(int(s.blocks[j])):
                        rows.append(at)
                        pivots.append(j)
                        salts.append(salt)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows, pa.int64())).columns, pa.array(pivots, pa.int32()), pa.array(salts, pa.int32())], [*b.schema.names, "pivot", "salt"])

    return route


def _searcher(space, same: bool, k: int):
    """Rows sorted by (pivot, salt, portion), a block's tree before its queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, block = space.value, None
        for b in batches:
            out: list[tuple] = []
            for tree, qid, label, v, floors, his in zip(*(b.column(c).to_pylist() for c in ("tree", "qid", "label", "v", "floors", "his"))):
                if tree is not None:
                    block = Block.load(tree)
                    continue
                query = np.zeros(s.dim, dtype=np.int64)
                query[: len(v)] = v
                for lo, hi, best in zip(floors, his, block.search(s, query, label, same, list(zip(floors, his)), k)):
                    out += [(qid, lo, hi, -score, i) for score, i in best]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["qid", "lo", "hi", "score", "id"])

    return search


def hard_negatives(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """rows (id, label, v) -> anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.  Anchors are the ids divisible by ``every``."""
    rows = written(rows, "vectors")
    order = W.partitionBy("label", "v").orderBy("id")
    kept = max(PER_ANCHOR, PER_PAIR) + 1
    candidates = (rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= kept)
                  .groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    index = Index(written(candidates, "distinct"))
    anchors = rows.filter(F.col("id") % every == 0)
    asked = written(anchors.groupBy("label", "v").agg(F.min("id").alias("qid")), "asked")
    whole = F.array(F.struct(F.lit(-_FAR).alias("lo"), F.lit(_FAR).alias("hi")))
    near = index.search(asked.withColumn("windows", whole), True, PER_ANCHOR + 1)
    near = written(near.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("near")), "positives")
    # the windows of all scores that may be a positive's
    window = F.transform(F.array_distinct(F.transform("near", lambda x: -x["minus"])), lambda p: F.struct(F.ceil(F.lit(LOW).cast("decimal(20,0)") * p / 100).cast("bigint").alias("lo"), p.alias("hi")))
    hard = index.search(asked.join(near, "qid").select("qid", "label", "v", window.alias("windows")), False, PER_PAIR)
    hard = hard.groupBy("qid", F.col("hi").alias("score")).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("hard"))
    # an anchor's positives: the best of its label but itself
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("anchor_id")), 1, PER_ANCHOR)
    named = anchors.join(asked, ["label", "v"]).select(F.col("id").alias("anchor_id"), "qid").join(near, "qid")
    pairs = named.select("anchor_id", "qid", F.explode(others).alias("p")).select("anchor_id", "qid", F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("score"))
    found = pairs.join(hard, ["qid", "score"]).select("anchor_id", "positive_id", F.col("score").alias("positive_score"), F.posexplode("hard").alias("place", "h"))
    return found.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("h.id").alias("negative_id"), "positive_score", (-F.col("h.minus")).alias("negative_score"))


def op11_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))
