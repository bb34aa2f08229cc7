"""Masks as scanline runs: (y, x0, x1) stands for the cells from x0 to x1 of row y, both included.

Sets of runs are combined by their ends: where a run begins its count rises, behind its end it falls, and a sum along each row tells which cells
are in how many runs. A row's ends are what moves in a shuffle, not its cells, and equal ends are summed up before.

Where a mask is what is wanted, runs are painted instead (`painted`): dealt to tiles of bounded size, which a task fills one after the other, so
that one shuffle of runs, which may overlap, does for union, difference, boundary and counts of neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Rows and columns of a tile, which a task holds in some arrays.
TALL, WIDE = 2048, 512


def disk_runs(points: DataFrame, height: int, width: int, outer: Column, inner: Column | None = None) -> DataFrame:
    """(segment_id, y, x0, x1): the rows of a disk around each point (segment_id, y, x), less its inner disk if there is one, inside the shape.

    A disk of radius r has 2 r + 1 rows, where it has about 3 r r cells.
    """
    zero = F.lit(0.0)
    around = points.withColumns({"_outer": F.greatest(outer, zero), "_inner": F.lit(-1.0) if inner is None else F.greatest(inner, zero)})
    reach = F.ceil("_outer").cast("int")
    rows = around.select("segment_id", "y", "x", "_outer", "_inner", F.explode(F.sequence(-reach, reach)).alias("dy"))

    def half(r: str) -> Column:
        """The largest dx with dy dy + dx dx <= r r, as integers and the square of r have it; null if there is none."""
        dy2 = (F.col("dy") * F.col("dy")).cast("double")
        square = F.col(r) * F.col(r)
        near = F.floor(F.sqrt(F.greatest(square - dy2, zero)))
        fits = lambda k: dy2 + (k * k).cast("double") <= square
        return F.when((F.col(r) >= 0) & fits(near + 1), near + 1).when((F.col(r) >= 0) & fits(near), near).when((F.col(r) >= 0) & (near > 0) & fits(near - 1), near - 1).cast("int")

    rows = rows.withColumns({"_k": half("_outer"), "_i": half("_inner")}).where("_k is not null")
    run = lambda a, b: F.struct((F.col("x") + a).cast("int").alias("x0"), (F.col("x") + b).cast("int").alias("x1"))
    k, i = F.col("_k"), F.col("_i")
    sides = F.when(i.isNull(), F.array(run(-k, k))).otherwise(F.array(run(-k, -i - 1), run(i + 1, k)))
    made = rows.select("segment_id", (F.col("y") + F.col("dy")).cast("int").alias("y"), F.explode(sides).alias("s")).select("segment_id", "y", F.greatest("s.x0", F.lit(0)).alias("x0"), F.least("s.x1", F.lit(width - 1)).alias("x1"))
    return made.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x0") <= F.col("x1")))


def combined(sets: Sequence[DataFrame], holds: Column, keys: Sequence[str] = ("y",)) -> DataFrame:
    """Runs of the cells for which `holds` is true, given the columns n0, n1, ..: in how many runs of each set a cell is. Runs that touch are one."""
    ends = None
    for i, runs in enumerate(sets):
        counts = [F.lit(int(k == i)).alias(f"n{k}") for k in range(len(sets))]
        falls = [(-c).alias(f"n{k}") for k, c in enumerate(counts)]
        both = F.explode(F.array(F.struct(F.col("x0").alias("x"), *counts), F.struct((F.col("x1") + 1).alias("x"), *falls)))
        own = runs.select(*keys, both.alias("e")).select(*keys, "e.*")
        ends = own if ends is None else ends.unionByName(own)
    summed = ends.groupBy(*keys, "x").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(sets))])
    row = Window.partitionBy(*keys).orderBy("x")
    along = summed.withColumns({f"n{k}": F.sum(f"n{k}").over(row) for k in range(len(sets))}).withColumn("_in", holds)
    turns = along.withColumn("_was", F.coalesce(F.lag("_in").over(row), F.lit(False))).where("_in <> _was")
    return turns.withColumn("x1", (F.lead("x").over(row) - 1).cast("int")).where("_in").select(*keys, F.col("x").alias("x0"), "x1")


def union(*sets: DataFrame, keys: Sequence[str] = ("y",)) -> DataFrame:
    held = F.lit(False)
    for k in range(len(sets)):
        held = held | (F.col(f"n{k}") > 0)
    return combined(sets, held, keys)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined((a, b), (F.col("n0") > 0) & (F.col("n1") == 0))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined((a, b), (F.col("n0") > 0) & (F.col("n1") > 0))


def eroded(runs: DataFrame) -> DataFrame:
    """Of runs that don't overlap: those of cells with all eight neighbours. Three shifted copies have to meet, and a run loses its two ends."""
    around = runs.select(F.explode(F.array(*[(F.col("y") + dy).alias("y") for dy in (-1, 0, 1)])).alias("y"), "x0", "x1")
    return combined((around,), F.col("n0") == 3).select("y", (F.col("x0") + 1).alias("x0"), (F.col("x1") - 1).alias("x1")).where("x0 <= x1")


def boundary(runs: DataFrame) -> DataFrame:
    """Of runs that don't overlap: those of cells without all eight neighbours."""
    return difference(runs, eroded(runs))


def of_pixels(mask: DataFrame) -> DataFrame:
    """Runs of a mask (y, x), whose pixels may repeat."""
    return union(mask.select("y", F.col("x").alias("x0"), F.col("x").alias("x1")))


def pixels(runs: DataFrame, keys: Sequence[str] = ("y",)) -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"))


# ---- runs in tasks ----


def merged(group: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the runs of each group (whole numbers from 0), sorted; runs that touch are one."""
    if not len(group):
        return group, x0, x1
    low, span = x0.min(), x1.max() - x0.min() + 3
    order = np.lexsort((x0, group))
    g = group[order].astype(np.int64)
    a, b = g * span + (x0[order] - low), g * span + (x1[order] - low)
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.append(True, a[1:] > reach[:-1] + 1))
    last = np.append(first[1:] - 1, len(a) - 1)
    return g[first], a[first] - g[first] * span + low, reach[last] - g[first] * span + low


def half_widths(dy: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The largest dx with dy dy + dx dx <= r r, as integers and the square of r have it; -1 if there is none."""
    dy2, square = (dy * dy).astype(float), r * r
    near = np.floor(np.sqrt(np.maximum(square - dy2, 0.0))).astype(np.int64)
    fits = lambda k: (r >= 0) & (k >= 0) & (dy2 + (k * k).astype(float) <= square)
    return np.select([fits(near + 1), fits(near), fits(near - 1)], [near + 1, near, near - 1], -1)


def disk_rows(y: np.ndarray, x: np.ndarray, outer: np.ndarray, inner: np.ndarray | None, height: int, width: int) -> tuple[np.ndarray, ...]:
    """(point, y, x0, x1): what disk_runs gives, point the number of the disk."""
    reach = np.ceil(outer).astype(np.int64)
    point = np.repeat(np.arange(len(y)), 2 * reach + 1)
    dy = np.arange(len(point)) - np.repeat(np.cumsum(2 * reach + 1) - (2 * reach + 1), 2 * reach + 1) - reach[point]
    k = half_widths(dy, outer[point])
    i = np.full(len(k), -1) if inner is None else half_widths(dy, inner[point])
    row, at = y[point] + dy, x[point]
    there = (k >= 0) & (row >= 0) & (row < height)
    whole, sides = there & (i < 0), there & (i >= 0)
    parts = [(whole, at - k, at + k), (sides, at - k, at - i - 1), (sides, at + i + 1, at + k)]
    point, row, a, b = (np.concatenate(v) for v in zip(*[(point[m], row[m], np.maximum(p[m], 0), np.minimum(q[m], width - 1)) for m, p, q in parts]))
    good = a <= b
    return point[good], row[good], a[good], b[good]


def of_mask(mask: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Runs (y, x0, x1), which may overlap, of a mask (y, x) or of what are runs already, and the columns to carry."""
    return mask.select("y", *(("x0", "x1") if "x0" in mask.columns else (F.col("x").alias("x0"), F.col("x").alias("x1"))), *carry)


def of_image(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1): the runs of an image."""
    turns = np.diff(np.pad(image, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, x0 = np.nonzero(turns > 0)
    return y, x0, np.nonzero(turns < 0)[1] - 1


def painted(sets: Sequence[DataFrame], made: Callable[..., np.ndarray], halo: int = 0, tall: int = TALL, wide: int = WIDE) -> DataFrame:
    """(y, x): the cells for which `made` is true, given an image of each set of runs (y, x0, x1), which may overlap; images have a border of
    `halo` cells more than the result."""

    def cells(y0: int, x0: int, *images: np.ndarray) -> list[np.ndarray]:
        y, x = np.nonzero(made(*images))
        return [(y + y0).astype(np.int32), (x + x0).astype(np.int32)]

    return by_tiles(sets, cells, "y int, x int", halo, tall, wide)


def by_tiles(sets: Sequence[DataFrame], made: Callable[..., list[np.ndarray]], schema: str, halo: int, tall: int = TALL, wide: int = WIDE) -> DataFrame:
    """What `made` gives for the first cell inside and the images of each tile.

    Runs are dealt to tiles and sorted by them, one shuffle for all sets; a task fills one tile at a time, however many runs cover it.
    """
    rows = None
    for k, own in enumerate(sets):
        own = own.select(F.lit(k).alias("kind"), "y", "x0", "x1")
        rows = own if rows is None else rows.union(own)
    down = F.explode(F.sequence(F.floor((F.col("y") - halo) / tall), F.floor((F.col("y") + halo) / tall))).alias("ty")
    across = F.explode(F.sequence(F.floor((F.col("x0") - halo) / wide), F.floor((F.col("x1") + halo) / wide))).alias("tx")
    dealt = rows.select(down, "*").select("ty", across, "kind", "y", "x0", "x1").repartition("ty", "tx").sortWithinPartitions("ty", "tx")
    shape = (len(sets), tall + 2 * halo, wide + 2 * halo + 1)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends = None, np.zeros(shape, np.int32)

        def finished() -> pa.RecordBatch:
            # rows and columns far from all runs have nothing
            held = [np.flatnonzero(ends.any(axes)) for axes in ((0, 2), (0, 1))]
            y, x = (slice(max(h[0] - 2 * halo, 0), min(h[-1] + 2 * halo + 1, n)) for h, n in zip(held, (shape[1], shape[2] - 1)))
            out = made(at[0] * tall + y.start, at[1] * wide + x.start, *(np.cumsum(ends[:, y, x], axis=2) > 0))
            return pa.RecordBatch.from_arrays([pa.array(v) for v in out], names)

        for batch in batches:
            ty, tx, kind, y, x0, x1 = (c.to_numpy().astype(np.int64) for c in batch.columns)
            turns = np.flatnonzero((ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(ty)]):
                if a == b:
                    continue
                if at != (now := (int(ty[a]), int(tx[a]))):
                    if at is not None:
                        yield finished()
                    at = now
                    ends[:] = 0
                part, left = slice(a, b), now[1] * wide - halo
                row = (kind[part], y[part] - now[0] * tall + halo)
                np.add.at(ends, (*row, np.maximum(x0[part] - left, 0)), 1)
                np.add.at(ends, (*row, np.minimum(x1[part] - left + 1, shape[2] - 1)), -1)
        if at is not None:
            yield finished()

    return dealt.mapInArrow(run, schema)


class Tile(Protocol):
    """What a task holds of one tile: rows are added as they come, which gives nothing yet or rows of the result, and what is left comes at the end."""

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]: ...

    def finished(self) -> Iterator[pa.RecordBatch]: ...


def streamed(rows: DataFrame, tile: Callable[[int, int], Tile], schema: str | StructType, order: Sequence[str] = ()) -> DataFrame:
    """What the tiles of rows (ty, tx, ..) give: dealt to tasks and sorted by tile, and within one by `order`, one shuffle; a task holds one tile at a time."""
    dealt = rows.repartition("ty", "tx").sortWithinPartitions("ty", "tx", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held = None
        for batch in batches:
            ty, tx = (batch.column(k).to_numpy() for k in (0, 1))
            turns = np.flatnonzero((ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(ty)]):
                if a == b:
                    continue
                if at != (now := (int(ty[a]), int(tx[a]))):
                    if held is not None:
                        yield from held.finished()
                    at, held = now, tile(*now)
                yield from held.add(batch.slice(a, b - a))
        if held is not None:
            yield from held.finished()

    return dealt.mapInArrow(run, schema)


def tiles_of(low: Column, high: Column, size: int, halo: int | Column, first: int | None = None) -> Column:
    """The tiles, a row each, in which the cells from low to high lie or of whose border of `halo` cells they are; given `first`, before which nobody asks, no tile that lies before it for its border."""
    start = F.floor((low - halo) / size)
    if first is not None:
        start = F.greatest(start, F.least(F.floor(low / size), F.lit(first // size)))
    return F.explode(F.sequence(start, F.floor((high + halo) / size)))


def _sum_around(m: np.ndarray) -> np.ndarray:
    """How many of a cell and its eight neighbours are set, for the cells inside."""
    n = m.astype(np.int8)
    rows = n[:-2] + n[1:-1] + n[2:]
    return rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]


def edge_cells(m: np.ndarray) -> np.ndarray:
    """Cells without all eight neighbours, of an image with a border of one."""
    return m[1:-1, 1:-1] & (_sum_around(m) < 9)


def crowded_cells(least: int) -> Callable[[np.ndarray], np.ndarray]:
    """Cells with at least so many of eight neighbours, of an image with a border of one."""
    return lambda m: m[1:-1, 1:-1] & (_sum_around(m) - 1 >= least)
