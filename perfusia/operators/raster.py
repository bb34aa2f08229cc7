"""Rasterised vessels. Masks are sparse: a row (y, x) is a cell that is set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfusia.functions import scalars
from perfusia.operators import runs
from perfusia.operators.nearest import nearest_points, nearest_runs


def _check(height: int, width: int) -> None:
    if height < 1 or width < 1:
        raise ValueError("a shape has a row and a column at least")


def in_bounds(cells: DataFrame, height: int, width: int) -> DataFrame:
    _check(height, width)
    return cells.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def centerline_pixels(segments: DataFrame, height: int, width: int) -> DataFrame:
    """(segment_id, pos, y, x, radius) of the rounded centerline points inside the shape."""
    radii = scalars.radii_along(F.col("radii"), F.col("centerline"))
    points = segments.select("segment_id", F.posexplode(F.arrays_zip(F.col("centerline").alias("p"), radii.alias("radius"))).alias("pos", "z"))
    points = points.select("segment_id", "pos", F.rint("z.p.y").cast("int").alias("y"), F.rint("z.p.x").cast("int").alias("x"), F.greatest(F.col("z.radius"), F.lit(0.0)).alias("radius"))
    return in_bounds(points, height, width)


def _points(batch: pa.RecordBatch, height: int, width: int) -> tuple[np.ndarray, ...]:
    """(row, pos, y, x, radius) of the points of centerline_pixels in a batch (.., centerline, radii), without those that repeat the one before."""
    line, radii = batch.column("centerline"), batch.column("radii")
    n = line.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    places = line.flatten()
    y, x = (np.rint(places.field(c).to_numpy(zero_copy_only=False)) for c in ("y", "x"))
    radius = np.nan_to_num(np.maximum(radii.flatten().to_numpy(zero_copy_only=False), 0.0), nan=0.0, posinf=np.inf)
    good = (y >= 0) & (y < height) & (x >= 0) & (x < width)
    same = (row[1:] == row[:-1]) & (y[1:] == y[:-1]) & (x[1:] == x[:-1]) & (radius[1:] == radius[:-1])
    good[1:] &= ~same
    return row[good], pos[good], y[good].astype(np.int64), x[good].astype(np.int64), radius[good]


def _drawn(segments: DataFrame) -> DataFrame:
    return segments.where("centerline is not null").select("segment_id", "centerline", scalars.radii_along(F.col("radii"), F.col("centerline")).alias("radii")).where("radii is not null")


def centerline_spots(segments: DataFrame, height: int, width: int) -> DataFrame:
    """(segment_id, pos, y, x): the pixels of centerlines, the first point of those that follow each other in one. A point a pixel apart makes one of some five."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, y, x, _ = _points(batch, height, width)
            yield pa.RecordBatch.from_arrays([batch.column("segment_id").take(pa.array(row)), *(pa.array(v.astype(np.int32)) for v in (pos, y, x))], ["segment_id", "pos", "y", "x"])

    _check(height, width)
    return _drawn(segments).mapInArrow(run, "segment_id long, pos int, y int, x int")


def centerline_runs(segments: DataFrame, height: int, width: int) -> DataFrame:
    """(segment_id, y, x0, x1): the pixels of each centerline as runs that don't overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, y, x, _ = _points(batch, height, width)
            group, x0, x1 = runs.merged(row * height + y, x, x)
            yield pa.RecordBatch.from_arrays([batch.column("segment_id").take(pa.array(group // height)), *(pa.array(v.astype(np.int32)) for v in (group % height, x0, x1))], ["segment_id", "y", "x0", "x1"])

    _check(height, width)
    return _drawn(segments).mapInArrow(run, "segment_id long, y int, x0 int, x1 int")


def centerline_mask(segments: DataFrame, height: int, width: int) -> DataFrame:
    return centerline_spots(segments, height, width).select("y", "x").distinct()


def stroke_runs(segments: DataFrame, height: int, width: int, radius_scale: float = 1.0, padding: float = 0.0, hollow: bool = False, apart: bool = True) -> DataFrame:
    """(segment_id, y, x0, x1): the union of disks along each segment, as runs that don't overlap; hollow: of rings, each disk less the one without
    padding. Segments are drawn where they are, without a shuffle. Not apart: (y, x0, x1), with the runs of segments that stand together merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, y, x, radius = _points(batch, height, width)
            step = max(1, int((1 << 20) / (2 * radius.max() * radius_scale + 2 * padding + 3))) if len(row) else 1
            cuts = [0]
            while cuts[-1] < len(row):  # whole segments, as many as make some million runs
                cuts.append(max(int(np.searchsorted(row, row[min(cuts[-1] + step, len(row) - 1)])), int(np.searchsorted(row, row[cuts[-1]], "right"))) if cuts[-1] + step < len(row) else len(row))
            for a, b in zip(cuts, cuts[1:]):
                outer = np.maximum(radius[a:b] * radius_scale + padding, 0.0)
                point, line, x0, x1 = runs.disk_rows(y[a:b], x[a:b], outer, radius[a:b] if hollow else None, height, width)
                if not apart:
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in runs.merged(line, x0, x1)], ["y", "x0", "x1"])
                    continue
                group, x0, x1 = runs.merged((row[a:b][point] - row[a]) * height + line, x0, x1)
                yield pa.RecordBatch.from_arrays([batch.column("segment_id").take(pa.array(group // height + row[a])), *(pa.array(v.astype(np.int32)) for v in (group % height, x0, x1))], ["segment_id", "y", "x0", "x1"])

    _check(height, width)
    return _drawn(segments).mapInArrow(run, "segment_id long, y int, x0 int, x1 int" if apart else "y int, x0 int, x1 int")


def segment_pixel_map(segments: DataFrame, height: int, width: int, radius_scale: float = 1.0) -> DataFrame:
    """(segment_id, y, x): the union of disks along each segment."""
    return runs.pixels(stroke_runs(segments, height, width, radius_scale), ("segment_id", "y"))


def vessel_runs(segments: DataFrame, height: int, width: int, radius_scale: float = 1.0, padding: float = 0.0) -> DataFrame:
    """The vessels as runs (y, x0, x1), which overlap where segments do."""
    return stroke_runs(segments, height, width, radius_scale, padding, apart=False)


def vessel_mask(segments: DataFrame, height: int, width: int, radius_scale: float = 1.0) -> DataFrame:
    return runs.painted([vessel_runs(segments, height, width, radius_scale)], lambda m: m)


def exchange_mask(segments: DataFrame, height: int, width: int, padding: float = 1.0) -> DataFrame:
    """Cells within radius + padding of a vessel that lie in no vessel."""
    return runs.painted([vessel_runs(segments, height, width, padding=padding), vessel_runs(segments, height, width)], lambda wide, narrow: wide & ~narrow)


def source_mask(segments: DataFrame, height: int, width: int, use_exchange_region: bool = False) -> DataFrame:
    return exchange_mask(segments, height, width) if use_exchange_region else vessel_mask(segments, height, width)


def exchange_pixel_map(segments: DataFrame, height: int, width: int, padding: float = 1.0) -> DataFrame:
    """(segment_id, y, x): rings around centerline points, each less its own disk only, so other points' disks can be in it."""
    return runs.pixels(stroke_runs(segments, height, width, padding=padding, hollow=True), ("segment_id", "y"))


def as_sorted_lists(pixel_map: DataFrame) -> DataFrame:
    return pixel_map.groupBy("segment_id").agg(F.sort_array(F.collect_set(F.struct("y", "x"))).alias("pixels"))


def boundary_mask(mask: DataFrame) -> DataFrame:
    """Cells of the mask, pixels or runs, without all eight neighbours in it; what lies outside counts as unset."""
    return runs.painted([runs.of_mask(mask)], runs.edge_cells, 1)


def vessel_boundary(segments: DataFrame, height: int, width: int) -> DataFrame:
    """boundary_mask of vessel_mask, without cells in between."""
    return boundary_mask(vessel_runs(segments, height, width))


def mask_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("y", "x").distinct().join(b.select("y", "x"), ["y", "x"], "left_anti")


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("y", "x").union(b.select("y", "x")).distinct()


def mask_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("y", "x").intersect(b.select("y", "x"))


def fit_mask(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Crops; a sparse mask needs no padding."""
    return in_bounds(mask.select("y", "x"), height, width)


def despeckle(mask: DataFrame, min_neighbors: int = 2) -> DataFrame:
    """Drops cells of a mask, pixels or runs, with fewer set neighbours of eight than asked."""
    return runs.painted([runs.of_mask(mask)], runs.crowded_cells(min_neighbors), 1)


def outline_with_skeleton(outline: DataFrame, skeleton: DataFrame) -> DataFrame:
    """(y, x, red, green, blue): outline white, skeleton red above it; other cells are black and left out."""
    both = outline.select("y", "x", F.lit(1.0).alias("white")).join(skeleton.select("y", "x", F.lit(True).alias("bone")), ["y", "x"], "full")
    rest = F.when(F.col("bone").isNotNull(), F.lit(0.0)).otherwise(F.lit(1.0))
    return both.select("y", "x", F.lit(1.0).alias("red"), rest.alias("green"), rest.alias("blue"))


def boundary_pixel_map(segments: DataFrame, boundary: DataFrame, height: int, width: int) -> DataFrame:
    """(segment_id, y, x): each boundary cell under the segment whose centerline is nearest; ties go to the first segment."""
    return nearest_points(boundary, centerline_runs(segments, height, width)).select("segment_id", "y", "x")


def reconstructed_boundary_runs(segments: DataFrame, vessel: DataFrame, height: int, width: int) -> DataFrame:
    """reconstructed_boundary_pixel_map as runs (segment_id, y, x0, x1) that don't overlap."""
    return nearest_runs(vessel, centerline_runs(segments, height, width), runs.edge_cells, 1, 0).select("segment_id", "y", "x0", "x1")


def reconstructed_boundary_pixel_map(segments: DataFrame, vessel: DataFrame, height: int, width: int) -> DataFrame:
    """boundary_pixel_map of the boundary of a mask, pixels or runs, which is found where its owners are."""
    return runs.pixels(reconstructed_boundary_runs(segments, vessel, height, width), ("segment_id", "y"))


def debug_masks(segments: DataFrame, skeleton: DataFrame, reconstruction: DataFrame, height: int, width: int) -> dict[str, DataFrame]:
    outline = boundary_mask(reconstruction)
    return {
        "centerline": centerline_mask(segments, height, width), "vessel": vessel_mask(segments, height, width), "outline": outline,
        "image": outline_with_skeleton(outline, skeleton), "segments": segment_pixel_map(segments, height, width),
    }


def mask_counts(masks: dict[str, DataFrame]) -> DataFrame:
    """(mask, pixels) of each."""
    out = None
    for name, mask in masks.items():
        own = mask.agg(F.count("*").alias("pixels")).select(F.lit(name).alias("mask"), "pixels")
        out = own if out is None else out.union(own)
    return out
