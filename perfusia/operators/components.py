"""Connected components by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from perfusia.sources.scratch import Scratch


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that links (a, b) join to a smaller one, and the smallest that they join it to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[i], low[j])
        after = low.copy()
        # both ends and what stood for them take the lesser label, then labels of labels
        for k in (i, j, low[i], low[j]):
            np.minimum.at(after, k, least)
        while (deeper := after[after]).tobytes() != after.tobytes():
            after = deeper
        if (after == low).all():
            break
        low = after
    moved = low < np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def contracted(edges: DataFrame, chunk: int = 1 << 20, span: int = 1 << 16) -> DataFrame:
    """Edges (a, b) of the same components, no more than before: up to `chunk` of those whose smaller ends lie in one span of ids become stars
    around their smallest nodes. Where near ids are near in the graph, as those of one order are, that settles most of it before the rounds of
    `components` begin. The shuffle by spans is a hint: a span with a hub in it may be split, which costs nothing but rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def held_stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(a, b)], ["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= chunk:
                yield held_stars(held)
                held, n = [], 0
        if n:
            yield held_stars(held)

    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    near = ends.withColumn("place", F.floor(F.least("a", "b") / span)).hint("rebalance", "place").select("a", "b")
    return near.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star rounds: each is a groupBy and a join over the edges, the
    number of rounds is logarithmic in the longest path, and no group is collected into one task.
    Empty edges give no rows; self-loops and repeated edges are harmless, null ends are ignored.
    """
    ends = edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct()

    def written(rows: DataFrame) -> tuple[DataFrame, tuple[int, int | None]]:
        """The rows as a durable table, and their number and fingerprint, observed as they are written."""
        seen = Observation()
        kept = scratch.keep(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")))
        return kept, (seen.get["n"], seen.get["mark"])

    now, mark = written(ends)
    while mark[0]:
        # large star: each neighbour above a node is linked to the least node around it
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node below is linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        (after, mark), last = written(small), mark
        scratch.drop(now)
        now = after
        if mark == last:
            break
    found = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return found.union(now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node")))
