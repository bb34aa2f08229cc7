"""Vessel geometry from a mask: skeleton, distance to the background, nodes and edges.

Thinning peels a mask layer by layer. Of a layer's pixels those go, one of the four checkerboard classes after another, without which their
neighbourhood stays in one piece and background stays joined to background. Pixels of a class don't touch, so a class goes at once as if one by one,
and components and holes stay as they are. Tiles are thinned in their own tasks, some layers at a time: what happens to a pixel in a layer depends on
five pixels around, so a tile with a border of five a layer comes out as in the whole image. Rounds end when a round removes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from perfusia.operators import runs, skeleton
from perfusia.operators.components import components
from perfusia.operators.nearest import nearest_points
from perfusia.sources.scratch import Scratch

#: A pixel's neighbours, around it.
AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
#: Pixels around that decide what a layer does to one.
REACH = 5


def _may_go(code: int) -> bool:
    """Whether a pixel with these neighbours is simple and no end: they are two or more in one piece, and a side is background."""
    on = [k for k in range(8) if code >> k & 1]
    if len(on) < 2 or all(code >> k & 1 for k in (1, 3, 5, 7)):
        return False
    todo, seen = [on[0]], {on[0]}
    while todo:
        y, x = AROUND[todo.pop()]
        for k in on:
            if k not in seen and max(abs(AROUND[k][0] - y), abs(AROUND[k][1] - x)) == 1:
                seen.add(k)
                todo.append(k)
    return len(seen) == len(on)


GOES = np.array([_may_go(c) for c in range(256)])


def thin_layers(image: np.ndarray, y0: int, x0: int, layers: int) -> np.ndarray:
    """The image, its first pixel at (y0, x0), without some layers."""
    return peeled(image, y0, x0, layers)[0]


def peeled(image: np.ndarray, y0: int, x0: int, layers: int, inside: tuple[slice, slice] = (slice(None), slice(None))) -> tuple[np.ndarray, bool]:
    """thin_layers, and whether the last layer took something inside, so that there may be more."""
    on = np.pad(image, 1)
    h, w = on.shape
    flat, steps = on.reshape(-1), [dy * w + dx for dy, dx in AROUND]
    within = np.zeros_like(on)
    within[1:-1, 1:-1][inside] = True
    within, took = within.reshape(-1), False
    for _ in range(layers):
        at = np.flatnonzero(image_of(on) & ~(on[:-2, 1:-1] & on[2:, 1:-1] & on[1:-1, :-2] & on[1:-1, 2:]))
        y, x = np.divmod(at, w - 2)
        at, kind = (y + 1) * w + x + 1, 2 * ((y0 + y) % 2) + (x0 + x) % 2
        gone = []
        for k in range(4):
            own = at[kind == k]
            code = np.zeros(len(own), np.uint8)
            for b, step in enumerate(steps):
                code |= flat[own + step].view(np.uint8) << np.uint8(b)
            gone.append(own[GOES[code]])
            flat[gone[-1]] = False
        gone = np.concatenate(gone)
        took = bool(within[gone].any())
        if not len(gone):
            break
    return image_of(on), took


def image_of(padded: np.ndarray) -> np.ndarray:
    return padded[1:-1, 1:-1].copy()


class _Layers:
    """The mask of a tile and around it; what some layers leave of the tile comes as runs."""

    def __init__(self, ty: int, tx: int, tall: int, wide: int, layers: int):
        self.tall, self.wide, self.layers, self.halo = tall, wide, layers, REACH * layers
        self.y0, self.x0 = ty * tall - self.halo, tx * wide - self.halo
        self.ends = np.zeros((tall + 2 * self.halo, wide + 2 * self.halo + 1), np.int32)

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        y, x0, x1 = (c.to_numpy().astype(np.int64) for c in rows.columns[2:])
        np.add.at(self.ends, (y - self.y0, np.maximum(x0 - self.x0, 0)), 1)
        np.add.at(self.ends, (y - self.y0, np.minimum(x1 - self.x0 + 1, self.ends.shape[1] - 1)), -1)
        return iter(())

    def finished(self) -> Iterator[pa.RecordBatch]:
        # beyond what is set there is background
        high, left = (np.flatnonzero(self.ends.any(axis)) for axis in (1, 0))
        top, left = int(high[0]), int(left[0])
        image = np.cumsum(self.ends[top : high[-1] + 1, left:-1], axis=1) > 0
        mine = tuple(slice(max(self.halo - first, 0), max(self.halo + size - first, 0)) for first, size in ((top, self.tall), (left, self.wide)))
        if not image[mine].any():
            return
        image, took = peeled(image, self.y0 + top, self.x0 + left, self.layers, mine)
        y, x0, x1 = (v + o for v, o in zip(runs.of_image(image[mine]), (self.y0 + top + mine[0].start, *[self.x0 + left + mine[1].start] * 2)))
        yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in (y, x0, x1)), pa.array(np.full(len(y), took))], ["y", "x0", "x1", "more"])


def thinned(mask: DataFrame, tile: int | None = None, layers: int = 8) -> DataFrame:
    """The skeleton (r, c) of a mask (y, x), or of runs, whose components and holes it keeps."""
    scratch = Scratch(mask.sparkSession, "thinning")
    held = scratch.keep(runs.of_mask(mask).select(*[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")]))
    return runs.pixels(thinned_runs(held, tile, tile, layers)).withColumnsRenamed({"y": "r", "x": "c"})


def thinned_runs(mask: DataFrame, tall: int | None = None, wide: int | None = None, layers: int = 8) -> DataFrame:
    """The skeleton as runs (y, x0, x1) of a durable table of runs, which may overlap. A round is one shuffle of runs."""
    scratch = Scratch(mask.sparkSession, "layers")
    tall, wide, halo = tall or runs.TALL, wide or runs.WIDE, REACH * layers
    box = mask.agg(*[f(c) for c, f in (("y", F.min), ("y", F.max), ("x0", F.min), ("x1", F.max))]).first()
    if box[0] is None:
        return mask.select("y", "x0", "x1")
    # tiles beside the mask have a border of it only, which nobody needs
    over = lambda a, b, size, low, high: F.explode(F.sequence(F.greatest(F.floor((F.col(a) - halo) / size), F.lit(low // size)), F.least(F.floor((F.col(b) + halo) / size), F.lit(high // size))))
    now = mask
    while True:
        dealt = now.select(over("y", "y", tall, *box[:2]).alias("ty"), "y", "x0", "x1").select("ty", over("x0", "x1", wide, *box[2:]).alias("tx"), "y", "x0", "x1")
        seen = Observation()
        peel = runs.streamed(dealt, lambda ty, tx: _Layers(ty, tx, tall, wide, layers), "y int, x0 int, x1 int, more boolean")
        after = scratch.keep(peel.observe(seen, F.count_if("more").alias("n")).select("y", "x0", "x1"))
        if now is not mask:
            scratch.drop(now)
        now = after
        if not seen.get["n"]:  # in no tile did the last layer take anything
            return now


def summary(mask: DataFrame, bones: DataFrame) -> DataFrame:
    """One row of a skeleton and its mask, both runs: euler of the skeleton, its pixels that thinning would still take, and those outside the mask. One shuffle."""

    def counts(y0: int, x0: int, thin: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
        own = thin[1:-1, 1:-1]
        return [np.array([n], np.int64) for n in (_corners(thin), (own & GOES[_code(thin)]).sum(), (own & ~whole[1:-1, 1:-1]).sum())]

    found = runs.by_tiles([bones, mask], counts, "euler long, deletable long, outside long", 1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return found.agg((total("euler") / 4).cast("long").alias("euler"), total("deletable").alias("deletable"), total("outside").alias("outside"))


def distance_map(mask: DataFrame, height: int, width: int) -> DataFrame:
    """(r, c, radius): the distance of each pixel of a mask (y, x) to the nearest background pixel of the image; without any background there is no row."""
    m = mask.select("y", "x").distinct()
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in AROUND])
    around = m.select("y", "x", F.explode(steps).alias("s")).select((F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()
    outside = around.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).join(m, ["y", "x"], "left_anti")
    # the owner of a background pixel is its own number
    owner = F.col("y").cast("long") * width + F.col("x")
    found = nearest_points(m, outside.select("y", "x", owner.alias("segment_id"), F.lit(0).alias("pos")))
    dy, dx = F.col("y") - F.floor(F.col("segment_id") / width), F.col("x") - F.col("segment_id") % width
    return found.select(F.col("y").alias("r"), F.col("x").alias("c"), F.sqrt((dy * dy + dx * dx).cast("double")).alias("radius"))


#: What a square of four pixels, by which are set, adds to four times components less holes.
CORNERS = np.zeros(16, np.int64)
CORNERS[[1, 2, 4, 8]], CORNERS[[7, 11, 13, 14]], CORNERS[[6, 9]] = 1, -1, -2


def _corners(image: np.ndarray) -> int:
    """The sum over squares whose first pixel lies inside an image with a border of one."""
    n = image.astype(np.int8)
    return int(CORNERS[n[1:-1, 1:-1] + 2 * n[1:-1, 2:] + 4 * n[2:, 1:-1] + 8 * n[2:, 2:]].sum())


def _code(image: np.ndarray) -> np.ndarray:
    """Which neighbours are set, for the cells inside an image with a border of one."""
    h, w = (n - 2 for n in image.shape)
    return sum(image[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w].astype(np.uint8) << b for b, (dy, dx) in enumerate(AROUND))


def euler(mask: DataFrame) -> DataFrame:
    """One row (euler) of a mask (y, x) of eight neighbours a pixel: components less holes, from the squares of four
    pixels: a quarter of those that hold one, less those that hold three, less twice those that hold two across."""
    found = runs.by_tiles([runs.of_mask(mask)], lambda y0, x0, image: [np.array([_corners(image)], np.int64)], "weight long", 1)
    return found.agg((F.coalesce(F.sum("weight"), F.lit(0)) / 4).cast("long").alias("euler"))


def deletable(bones: DataFrame) -> DataFrame:
    """Pixels (r, c) that thinning would still take: none of a skeleton."""
    goes = lambda image: image_of(image) & GOES[_code(image)]
    return runs.painted([runs.of_mask(bones.select(F.col("r").alias("y"), F.col("c").alias("x")))], goes, 1).withColumnsRenamed({"y": "r", "x": "c"})


def geometry(mask: DataFrame, height: int, width: int) -> dict[str, DataFrame]:
    """skeleton (r, c), distance (r, c, radius), nodes (node_id, row, col, node_type) and edges (edge_id, start_node, end_node, length_px, mean_radius, min_radius,
    max_radius, normalized_radius, points) of a mask (y, x).

    Skeleton pixels of other than two neighbours are nodes, those of three or more that touch one node, at the least of them;
    node_type is a node's number of edges. A ring without any has its least pixel for a node. Edges have their pixels (x, y) from node to node.
    """
    scratch = Scratch(mask.sparkSession, "geometry")
    bones = scratch.keep(thinned(mask))
    distance = scratch.keep(distance_map(mask, height, width))
    graph = scratch.keep(skeleton.skeleton_graph(bones))
    number = lambda r, c: F.shiftleft(F.col(r).cast("long"), 31).bitwiseOR(F.col(c).cast("long"))  # noqa: E731  as links have it
    pixels = scratch.keep(bones.select("r", "c", number("r", "c").alias("at")).join(graph.groupBy("r", "c").agg(F.count("*").alias("near")), ["r", "c"], "left").na.fill(0, ["near"]))
    none = pixels.where("false").select("at")
    arcs, links = skeleton.contract(graph, none, scratch)
    covered = arcs.select("at").union(arcs.select(number("nr", "nc"))).distinct()
    loose = scratch.keep(pixels.where("near = 2").join(covered, "at", "left_anti").select("at"))
    steps = graph.select(number("r", "c").alias("a"), number("nr", "nc").alias("b"))
    stops = none
    if loose.limit(1).count():
        rings = components(steps.join(loose.withColumnRenamed("at", "a"), "a", "left_semi"), scratch)
        stops = scratch.keep(rings.select(F.col("component").alias("at")).distinct())
        arcs, links = skeleton.contract(graph, stops, scratch)
    forks = pixels.where("near > 2").select("at")
    joined = components(steps.join(forks.withColumnRenamed("at", "a"), "a", "left_semi").join(forks.withColumnRenamed("at", "b"), "b", "left_semi"), scratch)
    held = pixels.where("near <> 2").select("at").union(stops).join(joined.withColumnRenamed("node", "at"), "at", "left").select("at", F.coalesce("component", "at").alias("node_id"))
    held = scratch.keep(held)
    side = lambda c, n: held.select(F.col("at").alias(c), F.col("node_id").alias(n))
    # each link stands once for both directions, that with the lesser end first, or of a loop's the lesser last arc; steps inside a node are none
    ways = links.join(side("at", "start_node"), "at").join(side("to", "end_node"), "to")
    back = F.least(F.col("link"), F.col("opposite"))
    ends = arcs.groupBy("link").agg(F.max_by(F.struct(number("nr", "nc").alias("at"), F.col("at").alias("to")), "left").alias("f"), F.min_by(F.struct(F.col("at").alias("at"), number("nr", "nc").alias("to")), "left").alias("l"))
    turned = ends.select("link", F.col("f.at").alias("a1"), F.col("f.to").alias("a0"), F.col("l.at").alias("z1"), F.col("l.to").alias("z0"))
    opposite = turned.select(F.col("link").alias("opposite"), F.col("a1").alias("z1"), F.col("a0").alias("z0"), F.col("z1").alias("a1"), F.col("z0").alias("a0"))
    ways = ways.join(turned.join(opposite, ["a0", "a1", "z0", "z1"]).select("link", "opposite"), "link")
    ways = ways.where((F.col("link") == back) & ((F.col("start_node") != F.col("end_node")) | (F.col("length") > 2)))
    place = F.struct("left", F.col("nc").cast("double").alias("x"), F.col("nr").cast("double").alias("y"), "radius", ((F.col("nr") != F.shiftright("at", 31)) & (F.col("nc") != F.col("at").bitwiseAND((1 << 31) - 1))).alias("slant"))
    along = ways.withColumnRenamed("at", "origin").join(arcs, "link")
    along = along.join(distance.withColumnsRenamed({"r": "nr", "c": "nc"}), ["nr", "nc"])
    edges = along.groupBy("link", "origin", "start_node", "end_node").agg(F.sort_array(F.collect_list(place), asc=False).alias("p"))
    start = F.array(F.struct(F.col("origin").bitwiseAND((1 << 31) - 1).cast("double").alias("x"), F.shiftright("origin", 31).cast("double").alias("y")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    edges = edges.select(
        F.col("link").alias("edge_id"), "start_node", "end_node", total(F.transform("p", lambda x: F.when(x["slant"], F.lit(2.0**0.5)).otherwise(1.0))).alias("length_px"),
        (total("p.radius") / F.size("p")).alias("mean_radius"), F.array_min("p.radius").alias("min_radius"), F.array_max("p.radius").alias("max_radius"),
        F.concat(start, F.transform("p", lambda x: F.struct(x["x"], x["y"]))).alias("points"),
    )
    edges = scratch.keep(edges)
    largest = edges.agg(F.max("mean_radius").alias("largest"))
    edges = edges.join(F.broadcast(largest)).withColumn("normalized_radius", F.col("mean_radius") / F.col("largest")).drop("largest")
    degree = edges.select(F.explode(F.array("start_node", "end_node")).alias("node_id")).groupBy("node_id").agg(F.count("*").cast("double").alias("node_type"))
    nodes = held.select("node_id").distinct().join(degree, "node_id", "left").na.fill(0.0, ["node_type"])
    nodes = nodes.select("node_id", F.shiftright("node_id", 31).cast("double").alias("row"), F.col("node_id").bitwiseAND((1 << 31) - 1).cast("double").alias("col"), "node_type")
    return {"skeleton": bones, "distance": distance, "nodes": nodes, "edges": edges}
