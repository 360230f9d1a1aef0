"""Exact centroid clustering with ball-tree filtering (operator 11).

Vectors become integer vectors.  Each task packs its vectors into metric trees of at most ``TREE_VECTORS``;
a ball of a tree stores an integer centre, a radius, how many vectors it holds and their integer sum.  The trees
are written once.  A round sends the centroids (``k`` of them, whatever the table) to the tasks; going down
each tree, the triangle inequality removes centroids that are farther from every vector of a ball than another
one.  A ball with one centroid left goes to it whole, by count and sum; a leaf with several left compares its
vectors exactly.  A task adds up what it assigns, so a round shuffles at most ``k`` rows per task and all
arithmetic is on integers: the same centroids come out of any partitioning.

Nothing is shuffled by vector, so equal vectors, however many, stay where they are; they make a ball of radius 0.

Defined results: vectors with other than 64 components or with null, NaN or infinite ones give no row; with
fewer kept vectors than ``k`` there are as many centroids as vectors; equal ids stay separate rows and are
ordered by their components where the start depends on it, a null id hashes as an empty number.  Components
of more than ``LARGEST`` in magnitude have no exact squared distance in a long: such vectors are returned with
null results and take no part.  A sum of distances beyond a long is null.  An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import expanded, materialise, release, squeezed, table

DIMENSIONS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
TREE_VECTORS = 8192
LEAF_VECTORS = 24
#: Largest component in magnitude whose scaled squares, 64 of them, still fit a long.
LARGEST = float(1 << 19)
#: Scaled components up to this give sums of products that doubles hold exactly.
_EXACT_DOUBLE = 1 << 21


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)


def square_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to integer centroids."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if largest <= _EXACT_DOUBLE:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None, :]


@dataclass
class BallTree:
    """Balls in order of their depth; a ball holds ``points[first:last]``, and its children are ``child`` and the next one (-1: leaf)."""

    points: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int = LEAF_VECTORS) -> tuple[BallTree, np.ndarray]:
        """The tree, and the order in which it holds the points."""
        order = np.arange(len(points))
        spans, centre, radius, total, child = [(0, len(points))], [], [], [], []
        for first, last in spans:  # grows meanwhile
            own = points[order[first:last]]
            total.append(own.sum(0))
            centre.append(total[-1] // (last - first))
            off = square_distances(own, centre[-1][None])[:, 0]
            far = int(off.argmax())
            # Rounded up: no vector of the ball is farther from its centre.
            radius.append(0.0 if not off[far] else float(np.sqrt(float(off[far]))) * (1 + 1e-12) + 1e-6)
            if last - first <= leaf or not off[far]:
                child.append(-1)
                continue
            other = int(square_distances(own, own[far][None])[:, 0].argmax())
            along = own @ (own[other] - own[far]).astype(np.float64)
            half = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(along, half)]
            child.append(len(spans))
            spans += [(first, first + half), (first + half, last)]
        edges = np.array(spans, dtype=np.int64)
        return cls(points[order], np.array(centre), np.array(radius), np.array(total), edges[:, 0], edges[:, 1], np.array(child)), order

    def assign(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, int | None]]:
        """(balls, centroid) of balls that go to a centroid whole, and (leaves, None) of those to be compared exactly."""
        balls, open_to = np.zeros(1, dtype=np.int64), np.ones((1, len(centroids)), dtype=bool)
        leaves = []
        while len(balls):
            square = np.where(open_to, square_distances(self.centre[balls], centroids), np.iinfo(np.int64).max)
            off = np.sqrt(square.astype(np.float64))
            near = open_to & (off <= (off.min(1) + 2 * self.radius[balls])[:, None] * (1 + 1e-9) + 1e-6)
            whole = (near.sum(1) == 1) | (self.radius[balls] == 0)
            best = square.argmin(1)
            for c in np.unique(best[whole]).tolist():
                yield balls[whole & (best == c)], c
            below = self.child[balls]
            leaves.append(balls[~whole & (below < 0)])
            down = ~whole & (below >= 0)
            balls = np.concatenate([below[down], below[down] + 1])
            open_to = np.concatenate([near[down], near[down]])
        yield np.concatenate(leaves), None

    def within(self, balls: np.ndarray) -> np.ndarray:
        """Places of the vectors in the balls."""
        sizes = self.last[balls] - self.first[balls]
        return np.repeat(self.first[balls] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of each centroid: how many, and their sum."""
        n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for balls, c in self.assign(centroids):
            if c is not None:
                n[c] += int((self.last[balls] - self.first[balls]).sum())
                total[c] += self.total[balls].sum(0)
                continue
            own = self.points[self.within(balls)]
            nearest = square_distances(own, centroids).argmin(1)
            n += np.bincount(nearest, minlength=len(n))
            for x in np.unique(nearest).tolist():
                total[x] += own[nearest == x].sum(0)
        return n, total

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each vector, in the tree's order."""
        label, off = np.zeros(len(self.points), dtype=np.int32), np.zeros(len(self.points), dtype=np.int64)
        for balls, c in self.assign(centroids):
            at = self.within(balls)
            if c is not None:
                label[at], off[at] = c, square_distances(self.points[at], centroids[c][None])[:, 0]
            else:
                square = square_distances(self.points[at], centroids)
                label[at] = square.argmin(1)
                off[at] = square.min(1, initial=np.iinfo(np.int64).max)
        return label, off

    def packed(self) -> dict[str, bytes]:
        """The tree as fields of a row; components in the narrowest integers that hold them."""
        kind = np.min_scalar_type(-int(np.abs(self.points).max(initial=1)) - 1)
        return {"kind": kind.str.encode(), "points": squeezed(self.points.astype(kind)), "centre": squeezed(self.centre.astype(kind)), "radius": squeezed(self.radius), "total": squeezed(self.total), "spans": squeezed(np.stack([self.first, self.last, self.child]))}

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> BallTree:
        whole = {c: expanded(row[c], np.dtype(row["kind"].decode())).astype(np.int64).reshape(-1, DIMENSIONS) for c in ("points", "centre")}
        first, last, child = expanded(row["spans"], np.int64).reshape(3, -1)
        return cls(**whole, radius=expanded(row["radius"], np.float64), total=expanded(row["total"], np.int64).reshape(-1, DIMENSIONS), first=first, last=last, child=child)


_PACKED = ("kind", "points", "centre", "radius", "total", "spans")


def grow_trees(vectors: DataFrame, most: int = TREE_VECTORS) -> DataFrame:
    """One row per tree of vectors(id, v): the packed tree and the ids in its order."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = [], [], 0

        def tree():
            grown, order = BallTree.grow(scaled(np.concatenate(parts).reshape(-1, DIMENSIONS)))
            own = pa.concat_arrays(ids).take(pa.array(order))
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([listed, *(pa.array([x], pa.binary()) for x in grown.packed().values())], ["ids", *_PACKED])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - size)
                ids.append(part.column(0))
                parts.append(part.column(1).flatten().to_numpy(zero_copy_only=False))
                at, size = at + part.num_rows, size + part.num_rows
                if size == most:
                    yield tree()
                    ids, parts, size = [], [], 0
        if size:
            yield tree()

    id_type = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(grow, f"ids array<{id_type}>, " + ", ".join(f"{c} binary" for c in _PACKED))


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, BallTree]]:
    for i in range(batch.num_rows):
        yield batch.column(0)[i].values, BallTree.unpacked({c: batch.column(c)[i].as_py() for c in _PACKED})


def next_centroids(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Means, rounded down, of the vectors nearest to each centroid; a centroid without vectors stays."""
    now = np.array(centroids, dtype=np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(now), dtype=np.int64), np.zeros(now.shape, dtype=np.int64)
        for batch in batches:
            for _, tree in _trees(batch):
                more, sums = tree.sums(now)
                n += more
                total += sums
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    wide = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(DIMENSIONS)]
    out = [list(c) for c in centroids]
    for r in trees.mapInArrow(add, "cluster int, n long, sums array<bigint>").groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(DIMENSIONS)]
    return out


def assigned(trees: DataFrame, centroids: list[list[int]], id_type: str) -> DataFrame:
    """(id, cluster, distance) of every vector in the trees."""
    now = np.array(centroids, dtype=np.int64)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch):
                clusters, off = tree.labels(now)
                yield pa.RecordBatch.from_arrays([ids, pa.array(clusters), pa.array(off)], ["id", "cluster", "distance"])

    return trees.mapInArrow(label, f"id {id_type}, cluster int, distance long")


def start_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("c")).orderBy("digest", "c").limit(k).collect()
    return [r.c for r in rows]


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector."""
    spark = embeddings.sparkSession
    v = F.col("v")
    finite = F.coalesce(F.size(v) == DIMENSIONS, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(finite)
    small = F.forall(v, lambda x: F.abs(x) <= LARGEST)
    vectors = rows.filter(small)
    id_type = embeddings.schema[id_col].dataType.simpleString()
    centroids = start_centroids(vectors, k, seed)
    beyond = rows.filter(~small).select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    if not centroids:
        return beyond
    trees = materialise(grow_trees(vectors), "ball-trees")
    for _ in range(rounds):
        centroids = next_centroids(trees, centroids)
    labels = materialise(assigned(trees, centroids, id_type), "ball-labels")
    release(trees)
    # At most k rows from here on.
    own = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own")).collect()
    total = sum(int(r.own) for r in own)
    long = lambda x: int(x) if x < 1 << 63 else None
    known = spark.createDataFrame([(r.cluster, long(r.own), long(total), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in own], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = labels.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return found.unionByName(beyond)


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """DuckDB's form: one row per component, nearest centroids and means once per round."""
    parts = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, v FROM kept)",
        "x AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM numbered)",
        f"c0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), v) - 1 AS c, v FROM numbered) WHERE c < {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"d{t} AS (SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{t} c USING (i) GROUP BY x.r, c.c)")
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT a.c, x.i, sum(x.x)::BIGINT AS s, count(*) AS n FROM a{t} a JOIN x USING (r) GROUP BY a.c, x.i)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c.c, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{t} c LEFT JOIN m{t} m USING (c, i))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, h.centroid_sha256 FROM a{rounds} a JOIN numbered USING (r) JOIN h ON h.c = a.c"
