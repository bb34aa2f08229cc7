"""From segment flows to concentrations and source maps on the tissue grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfusia.functions import scalars
from perfusia.operators import runs
from perfusia.operators.nearest import nearest_places
from perfusia.operators.raster import in_bounds
from perfusia.sources.scratch import Scratch


def uniform_concentrations(segments: DataFrame, oxygen: float = 1.0, carbon_dioxide: float = 0.0) -> DataFrame:
    return segments.select("segment_id", F.lit(oxygen).alias("oxygen"), F.lit(carbon_dioxide).alias("carbon_dioxide"))


def flow_weighted_concentrations(flows: DataFrame, inlet_oxygen: float = 1.0, inlet_carbon_dioxide: float = 0.0, minimum: float = 0.15) -> DataFrame:
    """Oxygen falls and carbon dioxide drops with the share of the largest flow that a segment lacks and has; all at the minimum if nothing flows."""
    largest = flows.agg(F.max(F.abs("flow_m3_per_s")).alias("largest"))
    share = scalars.retained_fraction(F.col("flow_m3_per_s"), F.col("largest"), minimum)
    return flows.join(F.broadcast(largest)).select("segment_id", (inlet_oxygen * share).alias("oxygen"), (inlet_carbon_dioxide - share).alias("carbon_dioxide"))


def _middles(pixel_map: DataFrame) -> DataFrame:
    """(segment_id, cy, cx, n) of a map of pixels or of runs that don't overlap: centroid and number of pixels."""
    if "x0" not in pixel_map.columns:
        return pixel_map.groupBy("segment_id").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count("*").alias("n"))
    n, ends = F.col("x1").cast("long") - F.col("x0") + 1, F.col("x1").cast("long") + F.col("x0")
    sums = pixel_map.groupBy("segment_id").agg(F.sum(n).alias("n"), F.sum(n * F.col("y")).alias("y"), F.sum(n * ends).alias("x"))
    return sums.select("segment_id", (F.col("y") / F.col("n")).alias("cy"), (F.col("x") / 2 / F.col("n")).alias("cx"), "n")


def centroids(pixel_map: DataFrame) -> DataFrame:
    return _middles(pixel_map).drop("n")


def complete_concentrations(pixel_map: DataFrame, concentrations: DataFrame, remap: bool = True) -> DataFrame:
    """Concentrations of the map's segments; with remap a segment without takes those of the solved one with the nearest
    boundary centroid, the least segment_id of equals. Solved segments without pixels are no candidates. The map (segment_id, y, x) may have runs (segment_id, y, x0, x1)."""
    return _completed(Scratch(pixel_map.sparkSession, "centroids").keep(_middles(pixel_map)) if remap else None, concentrations)


def _completed(middle: DataFrame | None, concentrations: DataFrame) -> DataFrame:
    known = concentrations.select("segment_id", "oxygen", "carbon_dioxide")
    if middle is None:
        return known
    solved = middle.join(known.select("segment_id"), "segment_id", "left_semi").select(F.col("segment_id").alias("owner"), "cy", "cx")
    lost = middle.join(known.select("segment_id"), "segment_id", "left_anti").select(F.col("segment_id").alias("lost"), "cy", "cx")
    found = nearest_places(lost, solved).join(known.withColumnRenamed("segment_id", "owner"), "owner")
    return known.union(found.select(F.col("lost").alias("segment_id"), "oxygen", "carbon_dioxide"))


def _valued(pixel_map: DataFrame, height: int, width: int, known: DataFrame) -> DataFrame:
    """Runs (ty, tx, segment_id, y, x0, x1, oxygen, carbon_dioxide) inside the shape, a run for each tile; a pixel repeated in a segment counts once."""
    own = pixel_map.select("segment_id", "y", "x0", "x1") if "x0" in pixel_map.columns else pixel_map.select("segment_id", "y", "x").distinct().select("segment_id", "y", F.col("x").alias("x0"), F.col("x").alias("x1"))
    inside = in_bounds(own.withColumn("x", F.greatest("x0", F.lit(0))), height, width).where("x1 >= 0")
    valued = inside.select("segment_id", "y", F.col("x").alias("x0"), F.least("x1", F.lit(width - 1)).alias("x1")).join(known, "segment_id")
    ty = F.floor(F.col("y") / (runs.TALL // 4)).alias("ty")
    return valued.select(ty, runs.tiles_of(F.col("x0"), F.col("x1"), runs.WIDE, 0).alias("tx"), "segment_id", "y", "x0", "x1", "oxygen", "carbon_dioxide")


class _Values:
    """The values of a tile's pixels: sums over segments or, with `last`, those of the last in order of id."""

    def __init__(self, ty: int, tx: int, tall: int, wide: int, last: bool):
        self.y0, self.x0, self.wide, self.last = ty * tall, tx * wide, wide, last
        size = tall * wide
        self.values, self.counts = np.zeros((2, size)), np.zeros((2, size), np.int32)  # what isn't null is counted
        self.set, self.segment = np.zeros(size, bool), np.full(size if last else 0, np.iinfo(np.int64).min)

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        segment, y, a, b = (c.to_numpy().astype(np.int64) for c in rows.columns[2:6])
        a, b = np.maximum(a - self.x0, 0), np.minimum(b - self.x0, self.wide - 1)
        n = b - a + 1
        run = np.repeat(np.arange(len(n)), n)
        at = ((y - self.y0) * self.wide + a - (np.cumsum(n) - n))[run] + np.arange(len(run))
        values = [c.to_numpy(zero_copy_only=False).astype(float) for c in rows.columns[6:8]]
        there = [~c.is_null().to_numpy(zero_copy_only=False) for c in rows.columns[6:8]]
        self.set[at] = True
        if not self.last:
            for k, (v, held) in enumerate(zip(values, there)):
                np.add.at(self.values[k], at, np.where(held, v, 0.0)[run])
                np.add.at(self.counts[k], at, held[run].astype(np.int32))
            return iter(())
        order = np.lexsort((segment[run], at))
        order = order[np.append(at[order][1:] != at[order][:-1], True)]
        order = order[segment[run[order]] >= self.segment[at[order]]]
        at, run = at[order], run[order]
        self.segment[at] = segment[run]
        for k, (v, held) in enumerate(zip(values, there)):
            self.values[k, at], self.counts[k, at] = v[run], held[run]
        return iter(())

    def finished(self) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(self.set)
        place = [pa.array((v + o).astype(np.int32)) for v, o in ((at // self.wide, self.y0), (at % self.wide, self.x0))]
        yield pa.RecordBatch.from_arrays([*place, *(pa.array(v[at], mask=n[at] == 0) for v, n in zip(self.values, self.counts))], ["y", "x", "oxygen", "carbon_dioxide"])


def _mapped(valued: DataFrame, last: bool) -> DataFrame:
    tall, wide = runs.TALL // 4, runs.WIDE
    return runs.streamed(valued, lambda ty, tx: _Values(ty, tx, tall, wide, last), "y int, x int, oxygen double, carbon_dioxide double")


def boundary_source_maps(
    height: int, width: int, pixel_map: DataFrame, concentrations: DataFrame, oxygen_scale: float = 1.0, carbon_dioxide_scale: float = 1.0, remap: bool = True, normalize: bool = False
) -> DataFrame:
    """(y, x, oxygen, carbon_dioxide): sums over segments; a pixel repeated in a segment counts once. With normalize a segment's
    value is shared among all its pixels, also those outside the shape. The map (segment_id, y, x) may have runs (segment_id, y, x0, x1), those of a segment apart; values
    meet in tiles, and a run is a row."""
    middle = Scratch(pixel_map.sparkSession, "centroids").keep(_middles(pixel_map)) if remap or normalize else None
    known = _completed(middle if remap else None, concentrations)
    weight = F.lit(1.0)
    if normalize:
        known, weight = known.join(middle.select("segment_id", "n"), "segment_id"), 1 / F.col("n")
    scaled = known.select("segment_id", (F.col("oxygen") * oxygen_scale * weight).alias("oxygen"), (F.col("carbon_dioxide") * carbon_dioxide_scale * weight).alias("carbon_dioxide"))
    return _mapped(_valued(pixel_map, height, width, scaled), False)


def boundary_concentration_maps(height: int, width: int, pixel_map: DataFrame, concentrations: DataFrame, remap: bool = True) -> DataFrame:
    """(y, x, oxygen, carbon_dioxide): of segments that share a pixel the last in order of id counts. The map may have runs, as in boundary_source_maps."""
    return _mapped(_valued(pixel_map, height, width, complete_concentrations(pixel_map, concentrations, remap)), True)


def densify(maps: DataFrame, height: int, width: int) -> DataFrame:
    grid = maps.sparkSession.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    return grid.join(maps, ["y", "x"], "left").na.fill(0.0, ["oxygen", "carbon_dioxide"])


def summarize_sources(maps: DataFrame, height: int, width: int) -> DataFrame:
    """Sums and extremes over the full grid: cells without a row are zeros."""
    full = F.count("*") == height * width
    zero = F.lit(0.0)
    top = lambda c: F.when(full, F.max(c)).otherwise(F.greatest(F.max(c), zero))
    low = lambda c: F.when(full, F.min(c)).otherwise(F.least(F.min(c), zero))
    return maps.agg(
        F.coalesce(F.sum("oxygen"), zero).alias("oxygen_total"), top("oxygen").alias("oxygen_max"),
        F.coalesce(F.sum("carbon_dioxide"), zero).alias("carbon_dioxide_total"), top("carbon_dioxide").alias("carbon_dioxide_max"), low("carbon_dioxide").alias("carbon_dioxide_min"),
    )
