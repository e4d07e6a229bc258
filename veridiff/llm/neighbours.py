"""Approximate nearest neighbours with a hierarchical k-means tree.

* The tree is fitted on the driver on at most ``SAMPLE`` vectors, chosen by hash of the identifier: k-means with ``BRANCH``
  centres, again inside each cluster, down to ``LEAF`` sampled vectors.  It is small (bounded by the sample) and broadcast.
* Every vector walks down to its leaf.  Equal vectors are kept once, with their k+1 smallest distinct identifiers, collapsed
  within each batch before they move; so a vector that a third of all rows hold is one entry.  Of more than k+1 identifiers
  at one distance no larger one can be among the k nearest, so nothing is lost.
* A query visits leaves best bin first: a priority queue over nodes by distance to their centre.  How many leaves it visits
  is calibrated: the count grows by a fifth until sampled queries reach ``RECALL`` against brute force over the distinct vectors
  of the sample, themselves left out (they lie further apart than those of the whole table, which makes the count a cautious
  one).  A query goes on past that count until its leaves hold more than k+1 identifiers, so outliers get k rows too; one
  that still finds fewer, for identifiers that repeat, searches every leaf.
* Queries meet vectors leaf by leaf.  A leaf larger than ``SLICE`` is dealt over several tasks, with a copy of the query each.
  Distances are computed in double precision on the original vectors, which move as they are stored (float or double).

Vectors that are null, zero or empty, hold null or non-finite components, or have another dimension than most, take no part,
as queries neither.  Ties go to the smaller identifier.  An identifier is one candidate: rows that repeat it count by their
nearest vector, and a query identifier with several rows by the nearest of them.  A query's own identifier is never its
neighbour.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import settle, tidy

SAMPLE = 1 << 17
BRANCH = 16
LEAF = 512
RECALL = 0.95
SLICE = 4096
TRIALS = 200


def _near(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each point."""
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, 1)


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = np.unique(points[rng.choice(len(points), min(len(points), 4 * k), replace=False)], axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(rounds):
        at = _near(points, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Tree:
    """Inner node: centres of its children and their numbers; leaves have numbers from 0."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)  # child c >= 0: inner node; else leaf ~c
    leaves: int = 0
    visits: int = 1

    @classmethod
    def fit(cls, points: np.ndarray, seed: int = 5) -> Tree:
        tree, rng = cls(), np.random.default_rng(seed)
        tree._grow(points, rng)
        return tree

    def _grow(self, points: np.ndarray, rng: np.random.Generator) -> int:
        if len(points) > LEAF:
            centres = _kmeans(points, BRANCH, rng)
            at = _near(points, centres)
            used = np.unique(at)
            if len(used) > 1:
                me = len(self.centres)
                self.centres.append(centres[used])
                self.children.append([])
                self.children[me] = [self._grow(points[at == c], rng) for c in used]
                return me
        self.leaves += 1
        return ~(self.leaves - 1)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            at = _near(points[rows], self.centres[node])
            for c, child in enumerate(self.children[node]):
                r = rows[at == c]
                if len(r):
                    if child < 0:
                        out[r] = ~child
                    else:
                        todo.append((child, r))
        return out

    def visit(self, point: np.ndarray, leaves: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The leaves to search, best bin first: so many, and more until they hold ``least`` identifiers by the counts ``held``."""
        if not self.centres:
            return [0]
        out: list[int] = []
        queue, have = [(0.0, 0)], 0
        while queue and (len(out) < leaves or have < least):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(~node)
                have += held.get(~node, 0) if held else 0
                continue
            d = ((self.centres[node] - point) ** 2).sum(1)
            for x, child in zip(d.tolist(), self.children[node]):
                heapq.heappush(queue, (x, child))
        return out

    def calibrate(self, points: np.ndarray, k: int, target: float = RECALL) -> float:
        """Raise ``visits`` by a fifth at a time until sampled queries reach the target; return their recall."""
        rng = np.random.default_rng(9)
        rows = np.ascontiguousarray(points)
        points = points[np.unique(rows.view(f"V{rows[0].nbytes}").ravel(), return_index=True)[1]]  # copies are found trivially
        k = min(k, len(points) - 1)
        if k < 1:
            return 1.0
        mine = rng.choice(len(points), min(TRIALS, len(points)), replace=False)
        tries = points[mine]
        leaf = self.leaf_of(points)
        d = (points**2).sum(1) - 2 * tries @ points.T + (tries**2).sum(1)[:, None]
        d[np.arange(len(mine)), mine] = np.inf  # a query is not its own neighbour
        kth = np.partition(d, k - 1, 1)[:, k - 1]
        orders = [self.visit(t, self.leaves) for t in tries]
        recall = 0.0
        while True:
            hit = 0
            for row, limit, order in zip(d, kth, orders):
                inside = np.isin(leaf, order[: self.visits])
                hit += min(k, int((row[inside] <= limit).sum()))
            recall = hit / (k * len(tries))
            if recall >= target or self.visits >= self.leaves:
                return recall
            self.visits = min(self.leaves, max(self.visits + 1, self.visits * 6 // 5))


def _stored(df: DataFrame, vec: str) -> type:
    """Float vectors move as floats, all others as doubles."""
    return np.float32 if df.schema[vec].dataType == ArrayType(FloatType(), df.schema[vec].dataType.containsNull) else np.float64


def usable(df: DataFrame, vec: str, id_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the rows that take part, and their dimension."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = df.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.cast(df.schema[vec].dataType if _stored(df, vec) == np.float32 else "array<double>").alias("vec"))
    top = ok.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return (ok.where(F.size("vec") == top[0]["n"]), top[0]["n"]) if top else (ok, 0)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest_neighbours(df: DataFrame, queries, k: int = 10, vec: str = "embedding", id_col: str = "vec_id", recall: float = RECALL) -> DataFrame:
    """query_id, rank, id, score: the k nearest rows of each row for which the condition ``queries`` (on "id") holds."""
    spark = df.sparkSession
    rows, dim = usable(df, vec, id_col)
    result = f"query_id long, rank int, {id_col} long, score double"
    if not dim:
        return spark.createDataFrame([], result)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()
    points = np.vstack([_matrix(c, dim) for c in sample.column("vec").chunks if len(c)]).astype(float)
    tree = Tree.fit(points)
    tree.calibrate(points, k, recall)
    shared = spark.sparkContext.broadcast(tree)
    keep, stored = k + 1, _stored(df, vec)
    width = f"V{np.dtype(stored).itemsize * dim}"

    def keys_of(m: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(m, stored).view(width).ravel()

    def points_of(keys) -> np.ndarray:
        return np.frombuffer(b"".join(keys), stored).reshape(-1, dim).astype(float)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, leaf, ids): the smallest distinct ids of each distinct vector of a batch."""
        for b in batches:
            m = _matrix(b.column(1), dim)
            if not len(m):
                continue
            held: dict[bytes, set[int]] = {}
            for x, i in zip(keys_of(m).tolist(), b.column(0).to_pylist()):
                held.setdefault(x, set()).add(i)
            leaf = shared.value.leaf_of(points_of(held))
            ids = [sorted(v)[:keep] for v in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(leaf), pa.array(ids, pa.list_(pa.int64()))], ["key", "leaf", "ids"])

    # dense ranks: rows that repeat an identifier share one
    first = Window.partitionBy("key").orderBy("id")
    unique = rows.mapInArrow(tidy(collapse), "key binary, leaf long, ids array<long>").select("key", "leaf", F.explode("ids").alias("id"))
    unique = unique.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= keep)
    unique = settle(unique.groupBy("key").agg(F.first("leaf").alias("leaf"), F.sort_array(F.collect_set("id")).alias("ids")), "vectors")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys_of(_matrix(b.column(1), dim)).tolist(), pa.binary())], ["query_id", "key"])

    asked = settle(rows.where(queries).mapInArrow(tidy(keyed), "query_id long, key binary").distinct(), "queries")

    # a row a leaf, bounded by the sample
    counts = unique.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect()
    held = spark.sparkContext.broadcast({r["leaf"]: r["n"] for r in counts})
    slices = unique.groupBy("leaf").agg(F.ceil(F.count("*") / SLICE).alias("slices"))  # a row a leaf, bounded by the sample
    right = unique.join(F.broadcast(slices), "leaf").select("key", "ids", "leaf", F.pmod(F.xxhash64("key"), "slices").alias("slice"))

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"place": [], "id": [], "score": []})
        points, ids, places = points_of(v["key"]), v["ids"].tolist(), q["place"].tolist()
        asked_points, squares = points_of(q["key"]), (points**2).sum(1)
        enough = min(keep, len({y for held in ids for y in held}))
        keys, found, scores = [], [], []
        for at in range(0, len(asked_points), 256):
            block = asked_points[at : at + 256]
            own = (block**2).sum(1)[:, None]
            rough = squares - 2 * block @ points.T + own
            # a product's rounding error is far below this slack; what lies within is measured exactly
            slack = 1e-9 * (own + squares.max())
            n = min(keep, len(points))
            limit = np.partition(rough, n - 1, 1)[:, n - 1 : n] + slack
            for x, p, far, top, eps in zip(places[at : at + 256], block, rough, limit, slack):
                n = min(keep, len(points))
                while True:
                    rows = np.flatnonzero(far <= top)
                    best: dict[int, float] = {}
                    for s, y in sorted((s, y) for s, i in zip(np.sqrt(((points[rows] - p) ** 2).sum(1)).tolist(), rows.tolist()) for y in ids[i]):
                        if len(best) < keep:
                            best.setdefault(y, s)
                    if len(best) >= enough:
                        break
                    n = min(2 * n, len(points))  # identifiers repeat: look further
                    top = np.partition(far, n - 1)[n - 1] + eps
                keys += [x] * len(best)
                found += best.keys()
                scores += best.values()
        return pd.DataFrame({"place": keys, "id": found, "score": scores})

    def meet(keys: DataFrame, visits: int) -> DataFrame:
        """(place, id, score): the nearest identifiers of each asked vector (place, key) in the leaves that it visits."""

        def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, leaves = [], []
                for i, x in enumerate(b.column(1).to_pylist()):
                    found = shared.value.visit(np.frombuffer(x, stored).astype(float), visits, held.value, keep + 1)
                    rows += [i] * len(found)
                    leaves += found
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(leaves, pa.int64())], ["place", "key", "leaf"])

        left = keys.select("place", "key").mapInArrow(tidy(routes), "place long, key binary, leaf long").join(F.broadcast(slices), "leaf")
        left = left.select("place", "key", "leaf", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        hits = left.groupBy("leaf", "slice").cogroup(right.groupBy("leaf", "slice")).applyInPandas(search, "place long, id long, score double")
        near = Window.partitionBy("place").orderBy("score", "id")
        hits = hits.repartition("place").groupBy("place", "id").agg(F.min("score").alias("score"))
        return hits.withColumn("r", F.row_number().over(near)).where(F.col("r") <= keep).drop("r")

    # distinct asked vectors have numbers, which travel with the hits instead of them
    places = settle(asked.select("key").distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    hits = settle(meet(places, tree.visits), "hits")
    short = settle(places.join(hits.groupBy("place").count().where(F.col("count") >= keep), "place", "left_anti"), "short")
    if tree.visits < tree.leaves and short.take(1):
        hits = hits.join(short.select("place"), "place", "left_anti").unionByName(meet(short, tree.leaves))
    mine = Window.partitionBy("query_id").orderBy("score", "id")
    out = asked.join(places, "key").join(hits, "place").where("id <> query_id").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
