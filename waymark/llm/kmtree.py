"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first, with as many leaves as calibrated recall asks for."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.base import prepare, scratch

FOUND = "query_id long, rank int, vec_id long, score double"
_HITS = "array<struct<less:double,id:bigint>>"


class Tree:
    """Nodes by number, 0 the root. `centres[i]`: those of node i's children; `children[i]`: their numbers, or none; `leaf[i]`: a leaf's number.

    Leaves are numbered depth first, so that near ones have near numbers.
    """

    def __init__(self, points: np.ndarray, branch: int, leaf_points: int, rounds: int, seed: int) -> None:
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        self._rng = np.random.default_rng(seed)
        self._grow(points, branch, leaf_points, rounds)

    def _grow(self, points: np.ndarray, branch: int, leaf_points: int, rounds: int) -> int:
        node = len(self.leaf)
        self.centres.append(points[:0])
        self.children.append([])
        self.leaf.append(-1)
        centres = self._means(points, min(branch, -(-len(points) // leaf_points)), rounds) if len(points) > leaf_points else points[:1]
        if len(centres) < 2:
            self.leaf[node], self.n_leaves = self.n_leaves, self.n_leaves + 1
            return node
        of = nearest(points, centres)
        self.centres[node] = centres
        self.children[node] = [self._grow(points[of == j], branch, leaf_points, rounds) for j in range(len(centres))]
        return node

    def _means(self, points: np.ndarray, k: int, rounds: int) -> np.ndarray:
        """Lloyd's means from k different points; those that lose all points are gone."""
        start = np.unique(points, axis=0)
        centres = start[self._rng.permutation(len(start))[:k]]
        for _ in range(rounds):
            of = nearest(points, centres)
            size = np.bincount(of, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, of, points)
            centres = sums[size > 0] / size[size > 0, None]
        used = np.bincount(nearest(points, centres), minlength=len(centres)) > 0
        return centres[used]

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: the nearest centre at each level."""
        out, todo = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            of = nearest(points[rows], self.centres[node])
            todo += [(c, rows[of == j]) for j, c in enumerate(self.children[node]) if (of == j).any()]
        return out

    def visit(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves by best bin first: go down to the nearest child, leave the others in a queue by distance, go on from its head."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            node = heapq.heappop(queue)[1]
            while self.leaf[node] < 0:
                away = ((self.centres[node] - query) ** 2).sum(1)
                j = int(away.argmin())
                for i, c in enumerate(self.children[node]):
                    if i != j:
                        heapq.heappush(queue, (float(away[i]), c))
                node = self.children[node][j]
            out.append(self.leaf[node])
        return out


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """x with one more coordinate that makes all lengths `longest`: then the nearest to (q, 0) has the largest inner product with q."""
    return np.hstack([x, np.sqrt(np.maximum(longest - (x**2).sum(1), 0))[:, None]])


def best(scores: np.ndarray, least: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` largest scores; of equal ones those with the smallest `least`."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > most:
        at = at[scores[at] >= np.partition(scores[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((least[at], -scores[at]))][:most]


def _hits(scores: np.ndarray, ids: list[list[int]], least: np.ndarray, most: int) -> list[dict[str, float]]:
    """The `most` best (score, id), each vector with all ids that it keeps."""
    found = sorted((-float(scores[j]), i) for j in best(scores, least, most) for i in ids[j])[:most]
    return [{"less": s, "id": i} for s, i in found]


def _merged(hits: DataFrame, most: int) -> DataFrame:
    """(a, b, hits): the best of a query's lists of hits. Lists are no longer than `most`, one for each place that was searched."""
    return hits.groupBy("a", "b").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, most).alias("hits"))


def search(
    vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, target: float = 0.97, sample: int = 50_000, leaf_rows: int = 256, branch: int = 16, trials: int = 256, shard_cells: int = 1 << 18, seed: int = 12
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` holds for, the k others with the largest inner products that the tree finds.

    The tree is fitted on about `sample` vectors (those with the smallest hashes, so the bound holds at every size); all rows are indexed.
    Of the queries about `trials` are answered by brute force over all rows, and every query visits as many leaves, best bin first, as those
    need for a recall of `target`. Leaves have about leaf_rows rows, or more where the sample is too small for so many leaves.

    Vectors that are null, empty, zero, of another length than the commonest (the larger of two as common), or hold nulls, NaN or
    infinities take no part, nor do rows without a key; a row repeated with its key counts once. Equal scores rank by key. Rows with the
    query's key are never its answers. Fewer than k candidates are all returned if found; an empty table gives no rows. Other columns aren't read.

    Equal vectors are searched once and found once, with their k + 1 smallest keys, so copies cost nothing. Places of search hold
    neighbouring leaves up to shard_cells numbers, or a part of a larger leaf, and meet their queries in blocks.
    """
    spark = vectors.sparkSession
    prepare(spark)
    keep = k + 1
    v = F.col("v")
    sound = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(v.isNotNull() & F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], FOUND)
    # 128 bits stand for a vector from here on.
    rows = rows.where(F.size("v") == size.d).groupBy("id", "v").agg(F.max("asks").alias("asks")).withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(seed), "v")})
    rows = scratch(rows)
    first = Window.partitionBy("a", "b").orderBy("id")
    squares = F.aggregate(v, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    distinct = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep).groupBy("a", "b").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = scratch(distinct.withColumn("squares", squares))
    asked = scratch(rows.where("asks").groupBy("a", "b").agg(F.first("v").alias("v"), F.min("id").alias("id")))
    n, longest = distinct.agg(F.count("*"), F.max("squares")).first()

    def share(df: DataFrame, many: int, of: int) -> DataFrame:
        """About `many` of the `of` rows, those with the smallest hashes."""
        return df.where(F.col("b") < int(-(2**63) + min(1.0, many / max(of, 1)) * (2**64 - 1)) if many < of else F.lit(True)).orderBy("b", "a")

    points = np.array([r.v for r in share(distinct.select("a", "b", "v"), sample, n).collect()], np.float64)
    tree = Tree(lifted(points, longest), branch, max(4, -(-len(points) * leaf_rows // n)), 8, seed)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaf", pa.array(tree.assign(lifted(_matrix(b["v"]), longest))))

    kind = rows.schema["v"].dataType.simpleString()
    indexed = scratch(distinct.select("a", "b", "v", "ids").mapInArrow(index, f"a long, b long, v {kind}, ids array<bigint>, leaf int"))
    visits = _calibrated(indexed, share(asked, trials, asked.count()).collect(), tree, k, target)

    # Leaves to shards: in order, up to `room` rows; a leaf beyond that has shards of its own, dealt by hash.
    room = max(16, shard_cells // size.d)
    first_of, parts, at, filled = np.zeros(tree.n_leaves, np.int64), np.ones(tree.n_leaves, np.int64), 0, 0
    counts = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    for leaf in range(tree.n_leaves):
        m = counts.get(leaf, 0)
        if filled and filled + m > room:
            at, filled = at + 1, 0
        first_of[leaf], parts[leaf], filled = at, max(1, -(-m // room)), filled + m
        if parts[leaf] > 1:
            at, filled = at + parts[leaf], 0
    places = spark.createDataFrame([(i, int(first_of[i]), int(parts[i])) for i in range(tree.n_leaves)], "leaf int, first long, parts long")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, shard, leaves = [], [], []
            for i, q in enumerate(np.hstack([_matrix(b["v"]), np.zeros((b.num_rows, 1))]) if b.num_rows else ()):
                mine: dict[int, list[int]] = {}
                for leaf in tree.visit(q, visits):
                    for s in range(first_of[leaf], first_of[leaf] + parts[leaf]):
                        mine.setdefault(int(s), []).append(leaf)
                of += [i] * len(mine)
                shard += mine
                leaves += mine.values()
            yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(of, pa.int64())) for c in "abv"), pa.array(shard, pa.int64()), pa.array(leaves, pa.list_(pa.int32()))], ["a", "b", "v", "shard", "leaves"])

    routed = scratch(asked.select("a", "b", "v").mapInArrow(route, f"a long, b long, v {kind}, shard long, leaves array<int>"))
    blocks = scratch(routed.groupBy("shard").agg(F.ceil(F.count("*") / 1024).alias("blocks")))
    left = indexed.join(F.broadcast(places), "leaf").withColumn("shard", F.col("first") + F.pmod("b", "parts")).join(blocks, "shard")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("shard", "block", "v", "ids", "leaf")
    right = routed.join(blocks, "shard").withColumn("block", F.pmod("a", "blocks")).select("shard", "block", "a", "b", "v", "leaves")

    def scan(_key: tuple[pa.Scalar, ...], there: pa.Table, asking: pa.Table) -> pa.Table:
        hits: list[list[dict[str, float]]] = []
        if there.num_rows and asking.num_rows:
            x, q, ids, leaf, leaves = _matrix(there["v"]), _matrix(asking["v"]), there["ids"].to_pylist(), there["leaf"].to_numpy(), asking["leaves"].to_pylist()
            least, score = np.array([i[0] for i in ids]), np.full((len(q), len(x)), -np.inf)
            visitors: dict[int, list[int]] = {}
            for i, several in enumerate(leaves):
                for one in several:
                    visitors.setdefault(one, []).append(i)
            for one, who in visitors.items():
                inside = np.flatnonzero(leaf == one)
                score[np.ix_(who, inside)] = q[who] @ x[inside].T
            hits = [_hits(row, ids, least, keep) for row in score]
        some = asking.slice(0, len(hits))
        return pa.table({"a": some["a"], "b": some["b"], "hits": pa.array(hits, pa.list_(pa.struct([("less", pa.float64()), ("id", pa.int64())])))})

    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(scan, f"a long, b long, hits {_HITS}")
    answers = scratch(_merged(hits, keep))
    out = rows.where("asks").select("id", "a", "b").join(answers, ["a", "b"])
    out = out.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def _calibrated(indexed: DataFrame, trials: list, tree: Tree, k: int, target: float) -> int:
    """How many leaves the trial queries must visit to find `target` of their true neighbours, which are found over all rows in blocks."""
    if not trials:
        return 1
    asked, names = np.array([r.v for r in trials], np.float64), [(r.a, r.b) for r in trials]

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[float, int, int]]] = [[] for _ in names]
        for b in batches:
            if b.num_rows:
                ids, leaf = b["ids"].to_pylist(), b["leaf"].to_pylist()
                least = np.array([i[0] for i in ids])
                for heap, row in zip(heaps, asked @ _matrix(b["v"]).T):
                    heap += [(-float(row[j]), i, leaf[j]) for j in best(row, least, k + 1) for i in ids[j]]
                    heap.sort()
                    del heap[k + 1 :]
        for (a, b_), heap in zip(names, heaps):
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b_, "hits": [{"less": s, "id": i, "leaf": f} for s, i, f in heap]}], schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hits", pa.list_(pa.struct([("less", pa.float64()), ("id", pa.int64()), ("leaf", pa.int32())])))]))

    found = _merged(indexed.select("v", "ids", "leaf").mapInArrow(brute, "a long, b long, hits array<struct<less:double,id:bigint,leaf:int>>"), k + 1)
    true = {(r.a, r.b): r.hits for r in found.collect()}
    at: list[int] = []
    for r in trials:
        order = {leaf: i for i, leaf in enumerate(tree.visit(np.append(np.array(r.v, np.float64), 0.0), tree.n_leaves))}
        at += [order[h.leaf] for h in true[r.a, r.b] if h.id != r.id][:k]
    visits = 1
    while at and sum(i < visits for i in at) < target * len(at):
        visits += 1
    return visits
