"""Skeleton graphs and shortest paths along them.

Pixels with two neighbours are contracted: pointer doubling tells every arc (a step from a pixel to a neighbour) the last arc of its link,
the run of steps up to the next junction, and how far it is from it. Links are few and join junctions, edges' ends among them; the
search runs on them for all edges at once, a job for each link that the longest path in links has, and no further from an edge's start than
its end. Paths are then written out from the arcs of their links.

A queue that visits neighbours in order finds, of all shortest paths to a pixel, the one whose steps come first in the order of visit, compared from the
start. Two paths can part at junctions only, by their links' first steps; so the search compares length and then first steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from perfusia.operators import runs
from perfusia.operators.components import components
from perfusia.sources.scratch import Scratch

#: Order in which a pixel's eight neighbours are visited.
STEPS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
#: Rounds of search after which edges without any path are looked for, so that they don't go on through all of a component.
PATIENCE = 12


def skeleton_graph(skeleton: DataFrame) -> DataFrame:
    """(r, c, nr, nc, ord): set neighbours of set pixels, ord the order of visit. Pixels meet in tiles: each moves once, and those at borders twice."""

    def steps(y0: int, x0: int, image: np.ndarray) -> list[np.ndarray]:
        y, x = np.nonzero(image[1:-1, 1:-1])
        near = [image[y + 1 + dr, x + 1 + dc] for dr, dc in STEPS]
        r, c = (np.concatenate([v[n] for n in near]).astype(np.int32) for v in (y + y0, x + x0))
        of = np.repeat(np.arange(len(STEPS), dtype=np.int32), [np.count_nonzero(n) for n in near])
        down, across = np.array(STEPS, np.int32).T
        return [r, c, r + down[of], c + across[of], of]

    pixels = runs.of_mask(skeleton.select(F.col("r").alias("y"), F.col("c").alias("x")))
    return runs.by_tiles([pixels], steps, "r int, c int, nr int, nc int, ord int", 1, tall=runs.TALL // 4)


def nearest_skeleton_pixel(points: DataFrame, skeleton: DataFrame, height: int, width: int, reach: int = 3) -> DataFrame:
    """points (id, row, col, ..) with sr, sc: the skeleton pixel nearest to the rounded, clipped point within +-reach, the first
    in row order of equals; the query fails if there is none.

    Skeleton pixels and points are dealt to tiles, the pixels also to those they border on, and sorted by them: one shuffle, in which a point is one
    row. A task holds the image of one tile, in which its points look around.
    """
    clip = lambda x, top: F.least(F.greatest(F.rint(x).cast("int"), F.lit(0)), F.lit(top - 1))
    tile = lambda c, n: F.floor(F.col(c) / n)
    at = points.select(clip(F.col("row"), height).alias("_r"), clip(F.col("col"), width).alias("_c"), *points.columns)
    tall, wide = runs.TALL, runs.WIDE
    asked = at.select(tile("_r", tall).alias("_ty"), tile("_c", wide).alias("_tx"), F.lit(True).alias("_asks"), "*")
    bones = skeleton.select(F.col("r").cast("int").alias("_r"), F.col("c").cast("int").alias("_c"))
    near = lambda c, n: F.explode(F.sequence(F.floor((F.col(c) - reach) / n), F.floor((F.col(c) + reach) / n)))
    held = bones.select(near("_r", tall).alias("_ty"), "*").select("_ty", near("_c", wide).alias("_tx"), F.lit(False).alias("_asks"), "_r", "_c")
    held = held.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema])
    dealt = held.union(asked).repartition("_ty", "_tx").sortWithinPartitions("_ty", "_tx", "_asks")
    around = sorted((dr * dr + dc * dc, dr, dc) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, image = None, np.zeros((tall + 2 * reach, wide + 2 * reach), bool)
        for batch in batches:
            ty, tx, asks, r, c = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            turns = np.flatnonzero((ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(ty)]):
                if a == b:
                    continue
                if at != (now := (int(ty[a]), int(tx[a]))):
                    at = now
                    image[:] = False
                y, x = r[a:b] - at[0] * tall + reach, c[a:b] - at[1] * wide + reach
                if not asks[a]:
                    image[y, x] = True
                    continue
                sr, sc, left = r[a:b].copy(), c[a:b].copy(), np.arange(b - a)
                for _, dr, dc in around:
                    hit = image[y[left] + dr, x[left] + dc]
                    sr[left[hit]] += dr
                    sc[left[hit]] += dc
                    left = left[~hit]
                    if not len(left):
                        break
                if len(left):
                    raise ValueError("no skeleton pixel near a point")
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns[5:], pa.array(sr.astype(np.int32)), pa.array(sc.astype(np.int32))], [*own.schema.names[5:], "sr", "sc"])

    return dealt.mapInArrow(run, StructType([*points.schema, StructField("sr", IntegerType()), StructField("sc", IntegerType())]))


def _pixel(r: str, c: str) -> Column:
    """A number for a pixel, of rows below 2^29."""
    return F.shiftleft(F.col(r).cast("long"), 31).bitwiseOR(F.col(c).cast("long"))


def contract(graph: DataFrame, stops: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Arcs (link, left, at, ord, nr, nc): the steps of each link, `left` counting down to 0 at its end; and links (link, at, first, to, length).

    graph (r, c, nr, nc, ord); stops (at): pixels that are junctions although they have two neighbours. A link is named by its last arc; closed rings
    without a junction have none.
    """
    near = graph.groupBy("r", "c").agg(F.collect_list(F.struct("ord", "nr", "nc")).alias("near")).withColumn("at", _pixel("r", "c"))
    pixels = scratch.keep(near.join(stops.select("at", F.lit(True).alias("stop")), "at", "left").select("at", "r", "c", "near", (F.col("stop").isNull() & (F.size("near") == 2)).alias("inner")))
    steps = pixels.select("at", "r", "c", F.explode("near").alias("s")).select("at", "r", "c", "s.*").withColumn("to", _pixel("nr", "nc"))
    heads = pixels.where("inner").select(F.col("at").alias("to"), F.col("near").alias("there"))
    on = F.filter("there", lambda n: (n["nr"] != F.col("r")) | (n["nc"] != F.col("c")))[0]["ord"]
    arc = lambda at, o: F.col(at) * 8 + o
    arcs = steps.join(heads, "to", "left").select(arc("at", F.col("ord")).alias("arc"), "at", "ord", "nr", "nc", F.when(F.col("there").isNotNull(), arc("to", on)).alias("next"))
    arcs = scratch.keep(arcs)

    def written(rows: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        return scratch.keep(rows.observe(seen, F.count_if(~F.col("done")).alias("open"))), seen.get["open"] or 0

    jumps, left = written(arcs.select("arc", F.coalesce("next", "arc").alias("link"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left"), F.col("next").isNull().alias("done")))
    while left:
        beyond = jumps.select(F.col("arc").alias("link"), F.col("link").alias("_link"), F.col("left").alias("_left"), F.col("done").alias("_done"))
        moved = jumps.where("not done").join(beyond, "link").select("arc", F.col("_link").alias("link"), (F.col("left") + F.col("_left")).alias("left"), F.col("_done").alias("done"))
        (after, now), last = written(jumps.where("done").union(moved)), left
        scratch.drop(jumps)
        jumps, left = after, now
        if left == last:  # what is left are rings
            break
    arcs = scratch.keep(arcs.join(jumps.where("done").select("arc", "link", "left"), "arc").select("link", "left", "at", "ord", "nr", "nc"))
    links = arcs.groupBy("link").agg(F.max_by(F.struct("at", "ord"), "left").alias("first"), F.min_by(_pixel("nr", "nc"), "left").alias("to"), (F.max("left") + 1).alias("length"))
    return arcs, scratch.keep(links.select("link", F.col("first.at").alias("at"), F.col("first.ord").alias("first"), "to", "length"))


class _Walks:
    """The skeleton in a tile and around, and a queue's search on it for each edge that begins in the tile. What would need pixels further out, or over `most`
    of them, isn't settled."""

    def __init__(self, ty: int, tx: int, tall: int, wide: int, halo: int, most: int):
        # a frame of one pixel without skeleton; the outermost pixels inside it have neighbours that aren't known
        self.y0, self.x0, self.high, self.across, self.most = ty * tall - halo - 1, tx * wide - halo - 1, tall + 2 * halo + 2, wide + 2 * halo + 2, most
        self.halo = halo
        self.on = np.zeros((self.high, self.across), np.uint8)
        self.cells: bytes | None = None

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kind, sr, sc, er, ec = (rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2, 7))
        bones = kind == 0
        self.on[sr[bones] - self.y0, sc[bones] - self.x0] = 1
        edges = np.flatnonzero(kind)
        if not len(edges):
            return
        if self.cells is None:
            frame = np.zeros_like(self.on)
            frame[[1, -2]] = frame[:, [1, -2]] = 1
            self.cells = (self.on + (self.on & frame)).tobytes()
        steps = [dr * self.across + dc for dr, dc in STEPS]
        inside = (er > self.y0) & (er < self.y0 + self.high - 1) & (ec > self.x0) & (ec < self.x0 + self.across - 1)
        start, end = ((r - self.y0) * self.across + c - self.x0 for r, c in ((sr, sc), (er, ec)))
        found = [self._way(a, b, steps) if near else None for a, b, near in zip(start[edges].tolist(), end[edges].tolist(), inside[edges].tolist())]
        sizes = np.array([len(w or ()) for w in found], np.int32)
        at = np.fromiter((p for w in found for p in w or ()), np.int64, int(sizes.sum()))
        places = pa.StructArray.from_arrays([pa.array((at // self.across + self.y0).astype(np.int32)), pa.array((at % self.across + self.x0).astype(np.int32))], ["r", "c"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), places)
        settled = pa.array([w is not None for w in found])
        own = rows.take(pa.array(edges))
        yield pa.RecordBatch.from_arrays([*own.columns[7:], *own.columns[3:7], settled, lists], [*own.schema.names[7:], *own.schema.names[3:7], "settled", "way"])

    def _way(self, start: int, end: int, steps: list[int]) -> list[int] | None:
        """Pixels from start to end; none if there is no path, None if that isn't known here."""
        if start == end:
            return [start]
        cells, before, queue = self.cells, {start: start}, [start]
        if not cells[start] or not cells[end]:
            return []
        for at in queue:
            if cells[at] == 2 or len(queue) > self.most:
                return None
            for step in steps:
                to = at + step
                if cells[to] and to not in before:
                    before[to] = at
                    if to == end:
                        way = [end]
                        while way[-1] != start:
                            way.append(before[way[-1]])
                        return way[::-1]
                    queue.append(to)
        return []

    def finished(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def walked(skeleton: DataFrame, ends: DataFrame, halo: int = 64, most: int = 4096) -> DataFrame:
    """ends (edge_id, sr, sc, er, ec) with settled and way (r, c), the pixels of the path a queue finds or none: those whose search stays within `halo`
    pixels of the tile they begin in and meets up to `most`. One shuffle of pixels and edges; a task holds one tile."""
    tall, wide = runs.TALL, runs.WIDE
    none, edge = F.lit(None), ends.schema["edge_id"].dataType
    over = lambda c, n: runs.tiles_of(F.col(c), F.col(c), n, halo, 0)  # noqa: E731  a skeleton's rows and columns begin at 0
    bones = skeleton.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    bones = bones.select(over("r", tall).alias("ty"), "*").select("ty", over("c", wide).alias("tx"), F.lit(0).alias("kind"), F.col("r").alias("sr"), F.col("c").alias("sc"), F.lit(0).alias("er"), F.lit(0).alias("ec"), none.cast(edge).alias("edge_id"))
    asked = ends.select(F.floor(F.col("sr") / tall), F.floor(F.col("sc") / wide), F.lit(1), *[F.col(c).cast("int") for c in ("sr", "sc", "er", "ec")], "edge_id")
    way = StructType([StructField("r", IntegerType()), StructField("c", IntegerType())])
    schema = StructType([StructField("edge_id", edge), *[StructField(c, IntegerType()) for c in ("sr", "sc", "er", "ec")], StructField("settled", BooleanType()), StructField("way", ArrayType(way))])
    return runs.streamed(bones.union(asked), lambda ty, tx: _Walks(ty, tx, tall, wide, halo, most), schema, ["kind"])


def traced_ways(skeleton: DataFrame, ends: DataFrame, on_missing: str = "fail") -> DataFrame:
    """(edge_id, way): the pixels (r, c) of a shortest path for each of ends (edge_id, sr, sc, er, ec), in order. Edges that a tile settles are traced there, the
    others by trace_far.

    on_missing: fail, or drop edges without a path.
    """
    scratch, seen = Scratch(skeleton.sparkSession, "walks"), Observation()
    counts = F.count_if(~F.col("settled")).alias("open"), F.count_if(F.col("settled") & (F.size("way") == 0)).alias("missing")
    found = scratch.keep(walked(skeleton, ends).observe(seen, *counts))
    if on_missing == "fail" and seen.get["missing"]:
        raise ValueError("no path along the skeleton between the ends of an edge")
    near = found.where("size(way) > 0").select("edge_id", "way")
    if not seen.get["open"]:
        return near
    far = trace_far(skeleton, found.where("not settled").select("edge_id", "sr", "sc", "er", "ec"), on_missing)
    lists = far.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("pos", "r", "c"))).alias("way"))
    return near.union(lists.select("edge_id", F.transform("way", lambda p: F.struct(p["r"].alias("r"), p["c"].alias("c")))))


def trace_paths(skeleton: DataFrame, ends: DataFrame, on_missing: str = "fail") -> DataFrame:
    """(edge_id, pos, r, c): traced_ways, a row for each pixel."""
    return traced_ways(skeleton, ends, on_missing).select("edge_id", F.posexplode("way").alias("pos", "p")).select("edge_id", "pos", "p.r", "p.c")


def trace_far(skeleton: DataFrame, ends: DataFrame, on_missing: str = "fail") -> DataFrame:
    """(edge_id, pos, r, c): a shortest path for each of ends (edge_id, sr, sc, er, ec), its pixels in order, however far it goes.

    on_missing: fail, or drop edges without a path.
    """
    scratch = Scratch(skeleton.sparkSession, "trace")
    ends = scratch.keep(ends.select("edge_id", "sr", "sc", "er", "ec", _pixel("sr", "sc").alias("start"), _pixel("er", "ec").alias("end")))
    arcs, links = contract(skeleton_graph(skeleton), ends.select(F.explode(F.array("start", "end")).alias("at")).distinct(), scratch)

    def written(rows: DataFrame, turn: int) -> tuple[DataFrame, int]:
        seen = Observation()
        return scratch.keep(rows.observe(seen, F.count_if(F.col("turn") == turn).alias("n"))), seen.get["n"] or 0

    # way: length and links so far, which compare as the queue would; turn: the round in which it was found
    start = F.struct(F.lit(0).cast("long").alias("length"), F.array().cast("array<struct<first:int,link:bigint,length:bigint>>").alias("links"))
    best, fresh = written(ends.select("edge_id", F.col("start").alias("at"), start.alias("way"), F.lit(0).alias("turn")), 0)
    turn = 0
    while fresh:
        turn += 1
        frontier = best.where(F.col("turn") == turn - 1)
        known = ends.join(best, (best.edge_id == ends.edge_id) & (best.at == ends.end)).select(ends.edge_id, F.col("way.length").alias("reached"))
        frontier = frontier.join(known, "edge_id", "left")
        if turn == PATIENCE:
            joined = components(links.select(F.col("at").alias("a"), F.col("to").alias("b")), scratch)
            side = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
            frontier = frontier.join(ends.join(side("start"), "start").join(side("end"), "end").where("start_component = end_component").select("edge_id"), "edge_id", "left_semi")
        on = frontier.join(links, "at").where(F.col("reached").isNull() | (F.col("way.length") + F.col("length") <= F.col("reached")))
        way = F.struct((F.col("way.length") + F.col("length")).alias("length"), F.concat("way.links", F.array(F.struct("first", "link", "length"))).alias("links"))
        found = on.select("edge_id", F.col("to").alias("at"), way.alias("way"), F.lit(turn).alias("turn"))
        merged = best.union(found).groupBy("edge_id", "at").agg(F.min(F.struct("way", "turn")).alias("b")).select("edge_id", "at", "b.way", "b.turn")
        (after, fresh), last = written(merged, turn), best
        scratch.drop(last)
        best = after
    ways = scratch.keep(ends.join(best.withColumnRenamed("at", "end"), ["edge_id", "end"]).select("edge_id", "sr", "sc", "way.links"))
    if on_missing == "fail" and ways.count() < ends.count():
        raise ValueError("no path along the skeleton between the ends of an edge")
    before = F.aggregate(F.slice("links", 1, F.col("k")), F.lit(0).cast("long"), lambda n, x: n + x["length"])
    used = ways.select("edge_id", "links", F.posexplode("links").alias("k", "l")).select("edge_id", before.alias("before"), "l.link", "l.length")
    inside = used.join(arcs, "link").select("edge_id", (F.col("before") + F.col("length") - F.col("left")).cast("int").alias("pos"), F.col("nr").alias("r"), F.col("nc").alias("c"))
    return scratch.keep(ways.select("edge_id", F.lit(0).alias("pos"), F.col("sr").alias("r"), F.col("sc").alias("c")).union(inside))


def edge_centerlines(skeleton: DataFrame, nodes: DataFrame, edges: DataFrame, height: int, width: int, on_missing: str = "fail") -> DataFrame:
    """(edge_id, points): traced centerlines as (x, y) of edges (edge_id, start_node, end_node) between nodes (node_id, row, col)."""
    snapped = nearest_skeleton_pixel(nodes.select(F.col("node_id").alias("id"), "row", "col"), skeleton, height, width)
    start = snapped.select(F.col("id").alias("start_node"), "sr", "sc")
    end = snapped.select(F.col("id").alias("end_node"), F.col("sr").alias("er"), F.col("sc").alias("ec"))
    ways = traced_ways(skeleton, edges.select("edge_id", "start_node", "end_node").join(start, "start_node").join(end, "end_node"), on_missing)
    return ways.select("edge_id", F.transform("way", lambda p: F.struct(p["c"].cast("double").alias("x"), p["r"].cast("double").alias("y"))).alias("points"))
