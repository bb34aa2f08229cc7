"""Approximate nearest neighbours by cosine: vantage-point trees per shard.

Vectors of length one are points of a metric space. A small tree fitted on a bounded sample of `sample` rows deals all rows to at
most `leaves` regions, those of over `shard_rows` rows further to shards by a hash, so no region makes a shard large. Each shard has a
vantage-point tree of all its rows: members are split at the median distance from a vantage point again and again, and a
leaf keeps the least and largest distance of its members from each vantage point above it. The triangle inequality then bounds
from below how near a leaf can be. A leaf, or a whole region, is passed over when `factor` times its bound lies beyond the k-th
nearest row so far: factor one restores exact search, larger ones visit less.

Queries go, in blocks, first to the shards of their own region, then with the distance of their k-th nearest to all others that
the same bound doesn't rule out. Trees are built where a shard meets a block of queries, which takes a small share of the search. Of equal vectors
only the k + 1 of smallest vec_id can be among the nearest, one of them the query's own, so a large group of copies counts k + 1 times.
Candidates are screened by a matrix product and then scored in double precision on the original vectors, component by component.

Defined cases: rows with a null vec_id, or a vector that is null, empty, zero or holds null or non-finite numbers take no part, as
queries or as candidates; only vectors of one length are compared, those of other lengths than most have regions by length; ties go
to the smaller vec_id; of rows that repeat a vec_id the one whose vector has the greatest bytes counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from perfusia.llm.shared import Scratch, table

#: Rounding moves a distance of near vectors by less than this, and a cosine by less than its hundredth.
SLACK = 1e-7
#: Queries in a block, and regions for vectors of odd lengths.
BLOCK, ODD = 1024, 64


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between vectors of length one."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows that face each other, each sum taken from the first component to the last."""
    total = lambda x, y: np.add.accumulate(x * y, axis=1)[:, -1] if len(x) else np.zeros(0)
    return total(a, b) / np.sqrt(total(a, a) * total(b, b))


@dataclass(frozen=True)
class Tree:
    """A balanced tree. Inner node i has the children 2 i and 2 i + 1, the root is 1; leaf j stands under the nodes above[j]."""

    pivots: np.ndarray
    cuts: np.ndarray
    above: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, away: np.ndarray) -> np.ndarray:
        """The least distance that any member of each leaf can have from points with these distances from the pivots."""
        out = np.zeros((len(away), len(self.above)))
        for level in range(self.above.shape[1]):
            d = away[:, self.above[:, level] - 1]
            np.maximum(out, np.maximum(self.low[:, level] - d, d - self.high[:, level]), out=out)
        return out

    def place(self, away: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.ones(len(away), int)
        for _ in range(self.above.shape[1]):
            node = 2 * node + (away[np.arange(len(away)), node - 1] > self.cuts[node - 1])
        return node - len(self.above)


def grow(points: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
    """A tree of 2 ** depth leaves over points of length one, and each point's leaf. A vantage point is the member farthest from the first."""
    pivots, cuts = np.zeros((2**depth - 1, points.shape[1])), np.zeros(2**depth - 1)
    members = {1: np.arange(len(points))}
    for node in range(1, 2**depth):
        own = members.pop(node)
        if len(own):
            away = distances(points[own], points[own[:1]])[:, 0]
            pivots[node - 1] = points[own[np.argmax(away)]]
            away = distances(points[own], pivots[node - 1 : node])[:, 0]
            order, half = np.argsort(away, kind="stable"), (len(own) + 1) // 2
            cuts[node - 1], own = away[order[half - 1]], own[order]
            members[2 * node], members[2 * node + 1] = own[:half], own[half:]
        else:
            members[2 * node] = members[2 * node + 1] = own
    leaf = np.zeros(len(points), int)
    for node, own in members.items():
        leaf[own] = node - 2**depth
    above = np.array([[(2**depth + j) >> up for up in range(1, depth + 1)] for j in range(2**depth)], int).reshape(2**depth, depth)
    low, high = np.full(above.shape, np.inf), np.full(above.shape, -np.inf)
    away = distances(points, pivots)
    for level in range(depth):
        d = away[np.arange(len(points)), above[leaf, level] - 1]
        np.minimum.at(low[:, level], leaf, d)
        np.maximum.at(high[:, level], leaf, d)
    return Tree(pivots, cuts, above, low, high), leaf


class Nearest:
    """The k best rows of each query so far, largest cosine first, ties by smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.ids, self.scores = k, np.full((queries, k), np.iinfo(np.int64).max), np.full((queries, k), -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(query)
        at = np.concatenate([np.repeat(touched, self.k), query])
        ids, scores = np.concatenate([self.ids[touched].ravel(), ids]), np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        self.ids[at[keep], place[keep]], self.scores[at[keep], place[keep]] = ids[keep], scores[keep]


def search(own_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, factor: float, leaf_rows: int = 256) -> tuple[Nearest, int]:
    """The k rows nearest to each query but its own, and the number of distances taken. least: cosines known to be reached by k rows elsewhere."""
    q, x = units(queries), units(rows)
    tree, leaf = grow(x, max(0, int(np.ceil(np.log2(max(1, len(x) / leaf_rows))))))
    members = [np.flatnonzero(leaf == j) for j in range(len(tree.above))]
    bounds = factor * tree.bounds(distances(q, tree.pivots))
    best, seen = Nearest(len(q), k), 0

    def visit(j: int, open_: np.ndarray) -> None:
        nonlocal seen
        own = members[j]
        reached = np.maximum(least[open_], best.scores[open_, -1])
        seen += len(open_) * len(own)
        i, p = np.nonzero(q[open_] @ x[own].T >= reached[:, None] - SLACK / 100)
        i, p = open_[i], own[p]
        other = own_ids[i] != ids[p]
        i, p = i[other], p[other]
        for part in range(0, len(i), 1 << 16):
            a, b = i[part : part + (1 << 16)], p[part : part + (1 << 16)]
            best.add(a, ids[b], cosines(queries[a], rows[b]))

    first = bounds.argmin(1)
    for j in range(len(members)):
        if len(open_ := np.flatnonzero(first == j)):
            visit(j, open_)
    for j in range(len(members)):
        radius = np.sqrt(np.maximum(2 - 2 * np.maximum(np.maximum(least, best.scores[:, -1]), -1), 0))
        if len(open_ := np.flatnonzero((bounds[:, j] <= radius + factor * SLACK) & (first != j))):
            visit(j, open_)
    return best, seen


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of rows that take part; a vector is its components as little-endian doubles, scaled by a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = [], []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.asarray(values.values.to_numpy(zero_copy_only=False), np.float64) if values.is_valid else np.zeros(0)
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(vec_id)
                    held.append(scaled(x[None])[0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], ["vec_id", "vector"])

    found = embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, vector binary")
    return found.groupBy("vec_id").agg(F.max("vector").alias("vector"))


@dataclass(frozen=True)
class Regions:
    """The tree that deals rows to regions, for vectors of `size` bytes; others go to regions below 0 by their length."""

    size: int
    tree: Tree

    def away(self, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which vectors the tree takes, and their distances from its pivots."""
        fits = np.array([len(v) == self.size for v in held], bool)
        points = np.frombuffer(b"".join(v for v in held if len(v) == self.size)).reshape(-1, max(self.size // 8, 1))
        return fits, distances(units(points), self.tree.pivots)


def _regions(rows: DataFrame, total: int, shard_rows: int, sample: int, leaves: int) -> Regions:
    """Fitted on the `sample` rows of least hash, those of the length that most of them have."""
    held = [bytes(r.vector) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").collect()]
    sizes = [len(v) for v in held]
    size = max(sorted(set(sizes)), key=sizes.count)
    points = units(np.frombuffer(b"".join(v for v in held if len(v) == size)).reshape(-1, size // 8))
    depth = int(np.log2(max(1, min(leaves, total // shard_rows, len(points) // 16))))
    return Regions(size, grow(points, depth)[0])


def _dealt(rows: DataFrame, regions: Regions) -> DataFrame:
    """rows with their region, and their distances from the vantage points above it."""
    shared = rows.sparkSession.sparkContext.broadcast(regions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_pylist()
            fits, away = shared.value.away(held)
            region = np.array([-1 - len(v) // 8 % ODD for v in held], np.int64)
            region[fits] = at = shared.value.tree.place(away)
            above = iter(np.take_along_axis(away, shared.value.tree.above[at] - 1, 1).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array([next(above) if f else [] for f in fits], pa.list_(pa.float64()))], ["vec_id", "vector", "region", "away"])

    return rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector binary, region long, away array<double>")


def _measured(dealt: DataFrame, regions: Regions) -> Regions:
    """Regions with the exact least and largest distances of all their rows: a row a region reaches the driver."""
    tree = regions.tree
    levels = range(tree.above.shape[1])
    low, high = np.full(tree.above.shape, np.inf), np.full(tree.above.shape, -np.inf)
    ends = [f(F.col("away")[t]).alias(f"{name}{t}") for t in levels for name, f in (("low", F.min), ("high", F.max))]
    for r in dealt.where("region >= 0").groupBy("region").agg(F.count("*"), *ends).collect():
        low[r["region"]], high[r["region"]] = [r[f"low{t}"] for t in levels], [r[f"high{t}"] for t in levels]
    return Regions(regions.size, Tree(tree.pivots, tree.cuts, tree.above, low, high))


def _visits(queries: DataFrame, regions: Regions, factor: float) -> DataFrame:
    """(query_id, vector, least, region) of the regions other than `home` that may hold rows nearer than `least` allows."""
    shared = queries.sparkSession.sparkContext.broadcast(regions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, away = shared.value.away(batch.column(1).to_pylist())
            at = np.flatnonzero(fits)
            least, home = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False))[at] for c in (2, 3))
            radius = np.sqrt(np.maximum(2 - 2 * np.maximum(least, -1), 0)) + factor * SLACK
            i, region = np.nonzero((factor * shared.value.tree.bounds(away) <= radius[:, None]) & (np.arange(len(shared.value.tree.above)) != home[:, None]))
            rows = pa.array(at[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), pa.array(region, pa.int64())], ["query_id", "vector", "least", "region"])

    return queries.select("query_id", "vector", "least", "home").mapInArrow(run, "query_id long, vector binary, least double, region long")


def _searched(visits: DataFrame, rows: DataFrame, shards: DataFrame, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score, seen): the k nearest in each shard of the regions visited. A task holds a shard and a block of queries.

    The tables of shards and blocks have a row a region, so they are broadcast."""
    blocks = visits.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    share = lambda c, n: F.pmod(F.xxhash64(c), F.greatest(F.col(n), F.lit(1)).cast("long"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    asked = visits.join(F.broadcast(blocks), "region").join(F.broadcast(shards), "region")
    asked = asked.select("region", F.explode(upto("shards")).alias("shard"), share("query_id", "blocks").alias("block"), "query_id", "vector", "least")
    held = rows.join(F.broadcast(shards), "region").join(F.broadcast(blocks), "region")
    held = held.select("region", share("vec_id", "shards").alias("shard"), F.explode(upto("blocks")).alias("block"), "vec_id", "vector")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 4))]
        for size in set(map(len, left.vector)) & set(map(len, right.vector)):
            a, b = left[left.vector.map(len) == size], right[right.vector.map(len) == size]
            matrix = lambda c: np.frombuffer(b"".join(c)).reshape(-1, size // 8)  # noqa: B023, E731
            best, seen = search(a.query_id.to_numpy(), matrix(a.vector), a.least.to_numpy(), b.vec_id.to_numpy(), matrix(b.vector), k, factor)
            i, j = np.nonzero(best.scores > -np.inf)
            out.append((a.query_id.to_numpy()[i], best.ids[i, j], best.scores[i, j], np.full(len(i), seen / len(a))))
        ids, found, score, seen = (np.concatenate([np.asarray(o[c]) for o in out[1:]]) if len(out) > 1 else [] for c in range(4))
        return pd.DataFrame({"query_id": ids, "vec_id": found, "score": score, "seen": seen})

    keys = ["region", "shard", "block"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double, seen double")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, factor: float = 1.0, shard_rows: int = 8192, sample: int = 4096, leaves: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each row of embeddings (vec_id, embedding) that is a query, itself left out.

    factor: 1 is exact, larger ones pass over more.
    """
    if factor < 1 or k < 1:
        raise ValueError("the factor is 1 or more, as is k")
    scratch = Scratch(embeddings.sparkSession, "vantage")
    seen = Observation()
    rows = scratch.keep(usable(embeddings).observe(seen, F.count(F.lit(1)).alias("n")))
    total = seen.get["n"] or 0
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    regions = _regions(rows, total, shard_rows, sample, leaves)
    # of equal vectors the k + 1 of smallest id; Spark keeps no more of them in each task before it shuffles
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    held = scratch.keep(_dealt(rows.withColumn("_place", place).where(F.col("_place") <= k + 1), regions))
    regions = _measured(held, regions)
    shards = scratch.keep(held.groupBy("region").agg(F.ceil(F.count("*") / shard_rows).alias("shards")))
    queries = scratch.keep(_dealt(rows.where(is_query), regions).select(F.col("vec_id").alias("query_id"), "vector", F.col("region").alias("home")))
    start = queries.select("query_id", "vector", F.lit(-2.0).alias("least"), F.col("home").alias("region"))
    at_home = scratch.keep(_first(_searched(start, held, shards, k, factor), k).drop("rank"))
    reached = at_home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    known = queries.join(reached, "query_id", "left").select("query_id", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"), "home")
    visits = scratch.keep(_visits(known, regions, factor))
    away = _searched(visits, held, shards, k, factor)
    return _first(at_home.union(away).select("query_id", "vec_id", "score"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op12_vantage_point_trees": op12_vantage_point_trees}

ORACLES = {
    "op12_vantage_point_trees": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (
  SELECT vec_id, e, list_dot_product(e, e) AS square FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) / sqrt(a.square * b.square) AS score
  FROM n a JOIN n b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
}
