"""Nearest neighbours by vantage-point trees.

Rows are dealt to shards by the upper levels of one tree, which is grown on a bounded sample and
sends every row down to a leaf. Each shard grows a tree of its own over all its rows: a node
holds a vantage point, its rows are halved by their distance to that point, and each half keeps
the least and the greatest of these distances. By the triangle inequality a half whose distances
lie between ``lo`` and ``hi`` holds nothing nearer to a query than ``max(lo - d, d - hi)``, where
``d`` is the query's own distance to the vantage point. A half is left out when this bound,
multiplied by ``relax``, is beyond the k-th distance found so far: with a factor of one the
search is exact, greater ones leave out more.

Queries start with their k-th distance to the sample, so whole shards can be left out before
any row moves, and visit every other shard. Rows with equal vectors are one point that carries
only the least ids, as no other id can be among the nearest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.vectors import as_matrix, clean_vectors
from riskloom.session import settle

SAMPLE = 4096  # rows of the sample for the upper levels, at most
MOST_SHARDS = 1024  # leaves of the upper levels, at most
SHARD_VALUES = 1 << 19  # numbers that a shard should hold while shards may still grow in number
FULL_SHARD = 1 << 24  # numbers in a shard from which it is cut by a hash of the id
LEAF = 256  # rows in a leaf of a shard's tree
SALTS = 16  # parts of a group of equal vectors before its least ids are merged
BLOCK = 512  # queries that go down a tree together
RELAX = 6.0  # measured: see README


@dataclass
class Node:
    """Rows ``start`` to ``end`` of the ordered matrix; a leaf has no vantage point."""

    start: int
    end: int
    point: np.ndarray | None = None
    near: Node | None = None
    far: Node | None = None
    near_range: tuple[float, float] = (0.0, 0.0)
    far_range: tuple[float, float] = (0.0, 0.0)
    leaf: int = -1


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - point) ** 2).sum(axis=1))


def grow(rows: np.ndarray, leaf_rows: int) -> tuple[Node, np.ndarray]:
    """Tree over all rows and the order in which its nodes hold them.

    The vantage point is the row farthest from the middle of the node; halves differ by one row
    at most, also among equal distances.
    """
    order = np.arange(len(rows))

    def node(start: int, end: int) -> Node:
        if end - start <= leaf_rows:
            return Node(start, end)
        own = order[start:end]
        held = rows[own]
        point = held[np.argmax(distances(held, held.mean(axis=0)))].copy()
        d = distances(held, point)
        by = np.argsort(d, kind="stable")
        order[start:end], d = own[by], d[by]
        half = (end - start) // 2
        ranges = (float(d[0]), float(d[half - 1])), (float(d[half]), float(d[-1]))
        del held, own, by
        return Node(start, end, point, node(start, start + half), node(start + half, end), *ranges)

    return node(0, len(rows)), order


def out_of_reach(d: np.ndarray, held: tuple[float, float], reach: np.ndarray, relax: float) -> np.ndarray:
    """Queries at distance ``d`` of the vantage point for which the half may be left out."""
    slack = 1e-9 * (d + held[1])  # rounding of distances never decides
    bound = np.maximum(held[0] - d, d - held[1]) - slack
    return bound * relax > reach


class Search:
    """The ``k`` nearest rows of one shard for a block of queries, by (distance, row number)."""

    def __init__(self, rows: np.ndarray, k: int, relax: float):
        self.root, self.order = grow(rows, LEAF)
        self.rows, self.k, self.relax = rows[self.order], k, relax
        self.squares = (self.rows**2).sum(axis=1)
        self.compared = 0

    def nearest(self, queries: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, distance) of what was found; nothing beyond ``reach`` is needed."""
        self.queries, self.square = queries, (queries**2).sum(axis=1)
        self.reach = reach.copy()
        self.found = [np.empty((0,), np.int64), np.empty((0,), np.int64), np.empty((0,))]
        self._visit(self.root, np.arange(len(queries)))
        return tuple(self.found)

    def _visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.point is None:
            return self._compare(node, who)
        d = distances(self.queries[who], node.point)
        inner = d <= (node.near_range[1] + node.far_range[0]) / 2
        halves = (node.near, node.near_range), (node.far, node.far_range)
        for first, (child, held) in ((True, halves[0]), (False, halves[1]), (False, halves[0]), (True, halves[1])):
            # each query sees the half on its own side first, then the other one
            go = (inner == first) if child is halves[0][0] else (inner != first)
            left = ~out_of_reach(d, held, self.reach[who], self.relax)
            self._visit(child, who[go & left])

    def _compare(self, node: Node, who: np.ndarray) -> None:
        """All rows of a leaf: a fast product rules out most pairs, the others are computed exactly."""
        rows = self.rows[node.start : node.end]
        self.compared += len(who) * len(rows)
        scale = self.square[who][:, None] + self.squares[node.start : node.end]
        rough = scale - 2 * self.queries[who] @ rows.T
        a, b = np.nonzero(rough <= (self.reach[who] ** 2)[:, None] + 1e-9 * scale)
        if not len(a):
            return
        q = who[a]
        d = np.sqrt(((self.queries[q] - rows[b]) ** 2).sum(axis=1))
        close = d <= self.reach[q]
        q, d, numbers = q[close], d[close], self.order[node.start : node.end][b[close]]
        touched = np.zeros(len(self.queries), bool)
        touched[q] = True
        old = touched[self.found[0]]
        parts = [np.concatenate([f[old], n]) for f, n in zip(self.found, (q, numbers, d))]
        order = np.lexsort((parts[1], parts[2], parts[0]))
        parts = [p[order] for p in parts]
        starts = np.searchsorted(parts[0], parts[0])
        place = np.arange(len(order)) - starts
        last = place == self.k - 1
        self.reach[parts[0][last]] = np.minimum(self.reach[parts[0][last]], parts[2][last])
        self.found = [np.concatenate([f[~old], p[place < self.k]]) for f, p in zip(self.found, parts)]


def _leaves(root: Node) -> list[Node]:
    """Leaves from the inside out, numbered in this order."""
    found: list[Node] = []

    def walk(node: Node) -> None:
        if node.point is None:
            node.leaf = len(found)
            found.append(node)
        else:
            walk(node.near)
            walk(node.far)

    walk(root)
    return found


def _open_ends(node: Node) -> None:
    """Halves of the sample's tree reach from 0 to the cut and from the cut on: all rows fit in."""
    if node.point is not None:
        cut = (node.near_range[1] + node.far_range[0]) / 2
        node.near_range, node.far_range = (0.0, cut), (cut, math.inf)
        _open_ends(node.near)
        _open_ends(node.far)


def route(root: Node, rows: np.ndarray) -> np.ndarray:
    """Leaf number of each row."""
    out = np.zeros(len(rows), np.int32)

    def down(node: Node, who: np.ndarray) -> None:
        if node.point is None:
            out[who] = node.leaf
        elif len(who):
            inner = distances(rows[who], node.point) <= node.near_range[1]
            down(node.near, who[inner])
            down(node.far, who[~inner])

    down(root, np.arange(len(rows)))
    return out


def reachable(root: Node, queries: np.ndarray, reach: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """(query number, leaf) for every leaf that cannot be left out."""
    who_all, leaf_all = [], []

    def down(node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.point is None:
            who_all.append(who)
            leaf_all.append(np.full(len(who), node.leaf, np.int32))
            return
        d = distances(queries[who], node.point)
        for child, (lo, hi) in ((node.near, node.near_range), (node.far, node.far_range)):
            slack = 1e-9 * (d + lo)
            bound = np.maximum(lo - d, d - hi) - slack
            down(child, who[bound * relax <= reach[who]])

    down(root, np.arange(len(queries)))
    return np.concatenate(who_all or [np.empty(0, np.int64)]), np.concatenate(leaf_all or [np.empty(0, np.int32)])


@dataclass
class Upper:
    """Upper levels: the sample, its tree and the number of leaves. Bounded by SAMPLE rows."""

    sample: np.ndarray
    root: Node
    shards: int


def upper_levels(points: DataFrame, dims: int, n: int) -> Upper:
    """Fitted on the SAMPLE distinct vectors with the least hashes (all, if fewer)."""
    picked = F.broadcast(points.select("h").distinct().orderBy("h.a", "h.b").limit(SAMPLE))  # SAMPLE rows
    held = points.join(picked, "h").groupBy("h").agg(F.first("v").alias("v")).select("h.a", "h.b", "v").toArrow()
    held = held.sort_by([("a", "ascending"), ("b", "ascending")]).combine_chunks()
    sample = as_matrix(held["v"].combine_chunks(), dims)
    wanted = min(MOST_SHARDS, math.ceil(n * dims / SHARD_VALUES), max(len(sample) // 4, 1))
    root, _ = grow(sample, math.ceil(len(sample) / max(wanted, 1)))
    _open_ends(root)
    return Upper(sample, root, len(_leaves(root)))


def _keyed(points: DataFrame) -> DataFrame:
    """With ``h``, two 64-bit hashes that stand for the vector."""
    return points.withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit("second"), "v").alias("b")))


def distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """(h, ids, v): each distinct vector once, with its ``k`` least distinct ids in order.

    Vectors are combined before their only shuffle. A group of equal vectors is dealt over SALTS
    parts by id; Spark keeps the least ids of each part before and after that shuffle of hashes
    and ids, and only these meet.
    """
    pairs = rows.select("h", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("h", "salt").orderBy("id"))
    few = pairs.withColumn("place", place).filter(F.col("place") <= k)
    ids = few.groupBy("h").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids"))
    return rows.groupBy("h").agg(F.first("v").alias("v")).join(ids, "h").select("h", "ids", "v")


def _dealt(upper: Upper, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = route(upper.root, as_matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return task


def _visits(upper: Upper, dims: int, k: int, relax: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries with their distance to the k-th row of the sample, once per leaf they have to see."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                queries = as_matrix(batch.column("v"), dims)
                reach = np.full(len(queries), np.inf)
                if len(upper.sample) >= k:
                    rough = (queries**2).sum(axis=1)[:, None] + (upper.sample**2).sum(axis=1) - 2 * queries @ upper.sample.T
                    near = np.argpartition(rough, k - 1, axis=1)[:, :k]
                    reach = np.sqrt(((queries[:, None, :] - upper.sample[near]) ** 2).sum(axis=2)).max(axis=1)
                who, leaf = reachable(upper.root, queries, reach, relax)
                moved = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([moved.column("h"), moved.column("v"), pa.array(reach[who]), pa.array(leaf)], ["h", "v", "reach", "leaf"])

    return task


def _searched(dims: int, k: int, relax: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task reads the points of a shard, grows their tree and lets the shard's queries pass in blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree, ids = None, [], None, None
        for whole in batches:
            keys = np.stack([whole.column(c).to_numpy() for c in ("leaf", "part")], axis=1)
            is_query = whole.column("reach").is_valid().to_numpy(zero_copy_only=False)
            marks = np.column_stack([keys, is_query])
            cuts = [0, *(np.nonzero((marks[1:] != marks[:-1]).any(axis=1))[0] + 1), whole.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if tuple(keys[start]) != shard:
                    shard, held, tree, ids = tuple(keys[start]), [], None, None
                run = whole.slice(start, end - start)
                if not is_query[start]:
                    held.append(run.select(["ids", "v"]))
                    continue
                if tree is None and held:
                    points = pa.Table.from_batches(held).combine_chunks()
                    least = pa.compute.list_element(points["ids"], 0)
                    points, held = points.take(pa.compute.sort_indices(least)).combine_chunks(), []  # row numbers now rank least ids
                    ids, tree = points["ids"].combine_chunks(), Search(as_matrix(points["v"].combine_chunks(), dims), k, relax)
                for at in range(0, run.num_rows if tree else 0, BLOCK):
                    block = run.slice(at, BLOCK)
                    q, found, d = tree.nearest(as_matrix(block.column("v"), dims), block.column("reach").to_numpy())
                    yield pa.RecordBatch.from_arrays([block.column("h").take(pa.array(q)), ids.take(pa.array(found)), pa.array(d)], ["h", "ids", "score"])

    return task


def nearest(
    table: DataFrame, queries: DataFrame, k: int = 10, relax: float = RELAX, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``table`` by Euclidean distance.

    ``queries`` has the same columns. A query never meets rows of its own id; ties go to the lesser id; fewer
    candidates than ``k`` are all returned. Null, empty and zero vectors, vectors with null or
    non-finite entries, rows with a null id and vectors of another length than most take no part.
    Rows that repeat an id and its vector count once; an id with several vectors is a query
    and a candidate with each of them, and is found once, at the nearest. Other columns are not read.
    """
    spark = table.sparkSession
    takes_part = F.col("id").isNotNull() & F.exists("v", lambda e: e != 0)
    rows, dims = clean_vectors(table, id_col, vector_col, takes_part)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, most = _keyed(rows), k + 1
    asked = _keyed(clean_vectors(queries, id_col, vector_col, takes_part, dims)[0])
    upper = upper_levels(rows, dims, rows.count())

    key, kind = "struct<a:bigint,b:bigint>", rows.schema["v"].dataType.simpleString()
    dealt = settle(distinct_points(rows, most).mapInArrow(_dealt(upper, dims), f"h {key}, ids array<bigint>, v {kind}, leaf int"), "vantage-points")
    per_leaf = dealt.groupBy("leaf").agg(F.ceil(F.count("*") * dims / FULL_SHARD).cast("int").alias("parts"))
    parts = F.broadcast(per_leaf)  # one row per leaf, MOST_SHARDS at most
    shards = dealt.join(parts, "leaf").withColumn("part", F.pmod("h.a", "parts").cast("int"))

    once = asked.groupBy("h").agg(F.first("v").alias("v"))
    visits = once.mapInArrow(_visits(upper, dims, most, relax), f"h {key}, v {kind}, reach double, leaf int")
    visits = visits.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shape = ["leaf", "part", "h", "ids", "v", "reach"]
    both = shards.withColumn("reach", F.lit(None).cast("double")).select(*shape)
    both = both.unionByName(visits.withColumn("ids", F.lit(None).cast("array<bigint>")).select(*shape))
    met = both.repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.col("reach").isNotNull())
    found = met.mapInArrow(_searched(dims, most, relax), f"h {key}, ids array<bigint>, score double")

    near = lambda order: F.row_number().over(Window.partitionBy("h").orderBy(*order))
    found = found.withColumn("place", near(["score", F.element_at("ids", 1)])).filter(F.col("place") <= most)
    found = found.select("h", F.explode("ids").alias("id"), "score").groupBy("h", "id").agg(F.min("score").alias("score"))
    best = found.withColumn("place", near(["score", "id"])).filter(F.col("place") <= most)
    lists = best.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("near"))
    # a third of all queries may share one vector: they are dealt over parts
    salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = asked.select("id", "h").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).distinct().withColumnRenamed("id", "query_id")
    own = F.slice(F.filter("near", lambda e: e["id"] != F.col("query_id")), 1, k)
    out = asked.join(salted, ["h", "salt"]).select("query_id", F.posexplode(own).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, vec_id) pairs that were found."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    total = exact.count()
    return hits.count() / total if total else 1.0
