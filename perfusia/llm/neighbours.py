"""Embedding near-duplicates by NN-descent.

Vectors are compared within a label by cosine. Bit-equal vectors are one node with a count. A first
neighbour graph comes from several random hyperplane orders: vectors sorted by their sign codes are
compared in overlapping runs of `leaf`. Rounds of NN-descent join neighbours of neighbours: all neighbours
that a node has in either direction meet, in blocks of bounded size dealt anew each round, and better
neighbours are kept. A list that is saturated, all of its `k` at or above the threshold, is enlarged to
`enlarged`, and by as much again each round that it stays saturated.

Whatever meets at or above the threshold counts, also what no list has room for: each meeting gives a spanning
forest of its links, verified in double precision, and components grow from these edges over the rounds. After
each round recall is audited by brute force on a bounded sample, of nodes with a near neighbour first, and
rounds go on until it is `recall`; after the last one a recall below `least_recall` is an error.
At last every component's members are compared block against block, so that each list covers its whole
component and links are counted exactly; only counts leave a task, never pairs.

Defined cases: a vector that is null, empty, zero or holds null or non-finite numbers, or whose label or id
is null, links with nothing and is its own component; vectors of other length never link; repeated rows are
other vectors with equal values, and link; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfusia.llm.shared import Scratch, components, table


#: Half precision moves a cosine by less than this.
HALF = 0.003
EDGE = ["a", "b", "sim", "link"], [pa.int64(), pa.int64(), pa.float64(), pa.int32()]


def _unit(values: list[float]) -> np.ndarray:
    x = np.asarray(values, np.float64)
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def _matrix(column: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _batch(columns: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _forest(near: np.ndarray, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a spanning forest of the links `near`; with `joined`, those of its links that connect trees of near."""
    root = list(range(len(near)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def grow(links: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for p, q in zip(*(x.tolist() for x in np.nonzero(np.triu(links, 1)))):
            if (r := top(p)) != (t := top(q)):
                root[t] = r
                out.append((p, q))
        return out

    found = grow(near)
    if joined is not None:
        tree = np.array([top(k) for k in range(len(near))])
        i, j = np.nonzero(np.triu(joined, 1) & (tree[:, None] != tree[None, :]))
        return i, j
    return (np.array([x[0] for x in found], int), np.array([x[1] for x in found], int))


def _nodes(rows: DataFrame, tables: int, planes: int, seed: int) -> DataFrame:
    """node, space (what may be compared), rep (least id), copies, u (unit vector, doubles), codes (signs for each order)."""
    grouped = rows.where("node is not null").groupBy("node", "label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    grouped = grouped.select("node", F.xxhash64("label", F.size("v")).alias("space"), "rep", "copies", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        for batch in batches:
            units = [_unit(v) for v in batch.column(4).to_pylist()]
            codes = []
            for u in units:
                if len(u) not in normals:
                    normals[len(u)] = np.random.default_rng([seed, len(u)]).standard_normal((tables, planes, len(u)))
                codes.append(((normals[len(u)] @ u > 0) @ (1 << np.arange(planes, dtype=np.int64))).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([u.tobytes() for u in units], pa.binary()), pa.array(codes, pa.list_(pa.int64()))], [*batch.schema.names[:4], "u", "codes"])

    return grouped.mapInArrow(run, "node long, space long, rep long, copies long, u binary, codes array<long>")


def _first_graph(nodes: DataFrame, k: int, threshold: float, leaf: int) -> DataFrame:
    """Directed edges (a, b, sim, link) between vectors near each other in an order of sign codes.

    link: 2 for a spanning forest of links, 1 for pairs that half precision leaves open between its trees, 0 for candidates.
    """

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = [np.frombuffer(x, np.float64).astype(np.float16).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(u, pa.binary()), batch.column(3)], ["node", "space", "u", "codes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def edges(rows: list[tuple]) -> pa.RecordBatch:
            x = _matrix([r[2] for r in rows], "f2").astype(np.float32)
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            ranks = np.argsort(np.argsort(-sims, axis=1), axis=1)
            sure, maybe = sims >= threshold + HALF, (sims >= threshold - HALF) & (sims < threshold + HALF)
            parts = [(*np.nonzero((ranks < k) & (sims > -2)), 0), (*_forest(sure, maybe), 1), (*_forest(sure), 2)]
            ids = np.array([r[1] for r in rows], np.int64)
            i, j, link = (np.concatenate(x) for x in zip(*((i, j, np.full(len(i), kind)) for i, j, kind in parts)))
            return _batch([ids[i], ids[j], sims[i, j].astype(float), link], *EDGE)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] != row[0]:
                    if len(held) > 1:
                        yield edges(held)
                    held = []
                held.append(row)
                if len(held) == leaf:
                    yield edges(held)
                    held = held[leaf // 2 :]
        if len(held) > 1:
            yield edges(held)

    orders = nodes.select("node", "space", "u", "codes").mapInArrow(half, "node long, space long, u binary, codes array<long>").select(F.posexplode("codes").alias("t", "code"), "node", "space", "u")
    # sorted by code within each order: equal codes are spread over tasks by node, so no key is hot
    orders = orders.select(F.xxhash64("t", "space").alias("g"), "code", "node", "u").repartitionByRange("g", "code", "node").sortWithinPartitions("g", "code", "node")
    return orders.select("g", "node", "u").mapInArrow(compare, "a long, b long, sim double, link int")


def _best(edges: DataFrame, k: int, enlarged: int, threshold: float) -> DataFrame:
    """a, near: its best neighbours (sim, b), each once: k or, if these are all at or above the threshold, up to `enlarged`."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    lists = once.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("sim", "b")), asc=False).alias("near"))
    return lists.select("a", F.when(F.try_element_at("near", F.lit(k))["sim"] >= threshold, F.slice("near", 1, enlarged)).otherwise(F.slice("near", 1, k)).alias("near"))


def _descend(graph: DataFrame, nodes: DataFrame, k: int, threshold: float, block: int, turn: int) -> DataFrame:
    """New edges (a, b, sim, link) among the neighbours that a node has in either direction; link: 2 for a spanning forest of links, 0 for candidates."""
    out = graph.select("a", F.explode("near").alias("n")).select("a", F.col("n.b").alias("b"))
    met = out.union(out.select("b", "a")).toDF("pivot", "x").distinct()
    blocks = met.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("blocks"))
    worst = graph.select(F.col("a").alias("x"), F.when(F.size("near") >= k, F.element_at("near", -1)["sim"]).otherwise(-1.0).alias("worst"))
    with_vectors = nodes.select(F.col("node").alias("x"), "u").join(worst, "x", "left")
    lists = (
        met.join(blocks, "pivot").withColumn("part", F.pmod(F.xxhash64("x", F.lit(turn)), F.col("blocks"))).join(with_vectors, "x")
        .groupBy("pivot", "part").agg(F.collect_list(F.struct("x", F.coalesce("worst", F.lit(-1.0)).alias("worst"), "u")).alias("l")).where("size(l) > 1").select("l")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for members in batch.column(0):
                flat = members.values
                ids, worst = flat.field("x").to_numpy(), flat.field("worst").to_numpy()
                x = _matrix(flat.field("u").to_pylist(), "f8")
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                ranks = np.argsort(np.argsort(-sims, axis=1), axis=1)
                for i, j, kind in ((*np.nonzero((sims > worst[:, None] + 1e-6) & (ranks < k)), 0), (*_forest(sims >= threshold), 2)):
                    found.append((ids[i], ids[j], sims[i, j], np.full(len(i), kind)))
            if found:
                yield _batch([np.concatenate(c) for c in zip(*found)], *EDGE)

    return lists.mapInArrow(run, "a long, b long, sim double, link int")


def _linked(open_pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those at or above the threshold in double precision."""
    near = open_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = near.join(nodes.select(F.col("node").alias("a"), F.col("u").alias("ua")), "a").join(nodes.select(F.col("node").alias("b"), F.col("u").alias("ub")), "b").select("a", "b", "ua", "ub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.array([np.frombuffer(p, "f8") @ np.frombuffer(q, "f8") >= threshold for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], bool)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(same, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _audit(nodes: DataFrame, graph: DataFrame, classes: DataFrame, threshold: float, sample: int) -> tuple[float, int]:
    """Of the links of `sample` nodes at most, found by brute force over all nodes, the share within a component, and their number.

    Half of the sample are nodes with the nearest neighbours known below the threshold or not far above it, where links are missed
    if anywhere, the rest any nodes, by hash.
    """
    close = graph.select(F.col("a").alias("node"), F.element_at("near", 1)["sim"].alias("best")).where((F.col("best") >= threshold - 0.05))
    mixed = F.xxhash64("node", F.lit(11))
    first = nodes.join(close, "node", "left_semi").orderBy(mixed, "node").limit(sample // 2)
    rest = nodes.orderBy(mixed, "node").limit(sample - sample // 2)
    chosen = list({r.node: tuple(r) for r in first.select("node", "space", "u").union(rest.select("node", "space", "u")).collect()}.values())
    shared = nodes.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple, list] = {}
        for node, space, u in shared.value:
            by.setdefault((space, len(u)), []).append((node, u))
        for batch in batches:
            rows: dict[tuple, list] = {}
            for node, space, u in zip(*(c.to_pylist() for c in batch.columns)):
                rows.setdefault((space, len(u)), []).append((node, u))
            for key, own in rows.items():
                if asked := by.get(key):
                    sims = _matrix([u for _, u in asked], "f8") @ _matrix([u for _, u in own], "f8").T
                    i, j = np.nonzero(sims >= threshold)
                    a, b = np.array([n for n, _ in asked], np.int64)[i], np.array([n for n, _ in own], np.int64)[j]
                    yield _batch([a[a != b], b[a != b]], ["a", "b"], [pa.int64(), pa.int64()])

    links = nodes.select("node", "space", "u").mapInArrow(run, "a long, b long")
    own = classes.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    other = classes.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    n, hit = links.join(own, "a", "left").join(other, "b", "left").agg(F.count("*"), F.sum(F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("int"))).first()
    return (hit / n if n else 1.0), n


def _count_links(nodes: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """node, links: other vectors at or above the threshold, copies counted, compared block against block within components."""
    sizes = classes.groupBy("component").agg(F.ceil(F.count("*") / block).alias("blocks"))
    members = classes.join(sizes, "component").join(nodes.select("node", "copies", "u"), "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    dealt = members.select("component", "block", "node", "copies", "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    lists = dealt.groupBy("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("block", "node", "copies", "u")).alias("l")).select("i", "j", "l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                flat = members.values
                own, ids, copies = flat.field("block").to_numpy(), flat.field("node").to_numpy(), flat.field("copies").to_numpy()
                x = _matrix(flat.field("u").to_pylist(), "f8")
                left, right = own == i, own == j
                near = x[left] @ x[right].T >= threshold
                if i == j:
                    np.fill_diagonal(near, False)
                    out = [(ids[left], near @ copies[right])]
                else:
                    out = [(ids[left], near @ copies[right]), (ids[right], copies[left] @ near)]
                yield _batch([np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])], ["node", "links"], [pa.int64(), pa.int64()])

    return lists.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


@dataclass(frozen=True)
class Search:
    """The result of a search, and how it was audited."""

    found: DataFrame
    recall: float
    links_audited: int
    rounds: int


def search(
    embeddings: DataFrame, threshold: float = 0.98, k: int = 8, enlarged: int = 64, tables: int = 6, planes: int = 30, leaf: int = 64,
    rounds: int = 6, recall: float = 0.99, least_recall: float = 0.9, sample: int = 1000, block: int = 256, count_block: int = 1024, seed: int = 7,
) -> Search:
    """vec_id, n_links, component_id and kept of embeddings (vec_id, embedding, label)."""
    scratch = Scratch(embeddings.sparkSession, "neighbours")
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "v")))
    nodes = scratch.keep(_nodes(rows, tables, planes, seed))
    met = scratch.keep(_first_graph(nodes, k, threshold, leaf))
    forest = met.where("link = 2").select("a", "b").union(_linked(met.where("link = 1"), nodes, threshold))
    graph, edges, most, done = None, met, enlarged, 0
    while True:
        graph = scratch.keep(_best(edges.where("link = 0").select("a", "b", "sim"), k, most, threshold))
        classes = scratch.keep(components(forest, scratch))
        if done:
            reached, links = _audit(nodes, graph, classes, threshold, sample)
            if reached >= recall or done == rounds:
                break
        done, most = done + 1, most * 2
        met = scratch.keep(_descend(graph, nodes, k, threshold, block, done))
        old = graph.select("a", F.explode("near").alias("n")).select("a", F.col("n.b").alias("b"), F.col("n.sim").alias("sim"), F.lit(0).alias("link"))
        edges = old.union(met)
        # components so far are a star each, and grow by the links of this round
        forest = classes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(met.where("link = 2").select("a", "b"))
    if reached < least_recall:
        raise ArithmeticError(f"NN-descent found {reached:.3f} of {links} audited links after {done} rounds")
    counted = _count_links(nodes, classes, threshold, count_block)
    named = classes.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    known = (
        nodes.select("node", "rep", "copies").join(classes, "node", "left").join(named, "component", "left").join(counted, "node", "left")
        .select("node", F.coalesce("least", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    found = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    found = found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return Search(found, reached, links, done)


def near_duplicates(embeddings: DataFrame, **options) -> DataFrame:
    return search(embeddings, **options).found


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_nn_descent": op2_nn_descent}

ORACLES = {
    "op2_nn_descent": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), n AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) >= 0.98 * a.norm * b.norm
), reach(id, to_id) AS (
  SELECT vec_id, vec_id FROM n
  UNION
  SELECT r.id, p.b FROM reach r JOIN pairs p ON r.to_id = p.a
), least AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
SELECT n.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = n.vec_id)::BIGINT AS n_links, component_id, n.vec_id = component_id AS kept
FROM n JOIN least ON least.id = n.vec_id
"""
}
