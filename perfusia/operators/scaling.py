"""Moving vessel geometry from image to simulation resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a band, whose pixels a shuffle leaves together.
BAND = 256


def scale_nodes(nodes: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Rows and columns by the ratio of shapes (rows, cols)."""
    return nodes.withColumns({"row": F.col("row") * (target[0] / source[0]), "col": F.col("col") * (target[1] / source[1])})


def scale_edges(edges: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Length and radii by the mean ratio; normalized_radius stays."""
    ratio = (target[0] / source[0] + target[1] / source[1]) / 2
    return edges.withColumns({c: F.col(c) * ratio for c in ("length_px", "mean_radius", "min_radius", "max_radius") if c in edges.columns})


def scale_skeleton(skeleton: DataFrame, distance: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(r, c, radius) of target pixels: places round half to even and stay inside; of pixels that meet the widest counts."""
    return scaled_pixels(with_distance(skeleton, distance), source, target)


def banded(pixels: DataFrame) -> DataFrame:
    """Pixels (r, c, ..) in the order of rows within bands of rows, each band in one partition."""
    return pixels.repartition(F.floor(F.col("r") / BAND)).sortWithinPartitions("r", "c")


def with_distance(skeleton: DataFrame, distance: DataFrame) -> DataFrame:
    """(r, c, radius) of the pixels that both have, once each; of several distances the widest counts. Pixels are dealt by bands of rows, a shuffle
    that leaves neighbours together, and meet there."""
    both = skeleton.select("r", "c", F.lit(None).cast("double").alias("radius"), F.lit(True).alias("bone")).union(distance.select("r", "c", F.col("radius").cast("double"), F.lit(False)))
    met = both.withColumn("band", F.floor(F.col("r") / BAND)).repartition("band").groupBy("band", "r", "c").agg(F.max("radius").alias("radius"), F.max("bone").alias("some"), F.min("bone").alias("all"))
    return met.where("some and not all").select("r", "c", "radius")


def scaled_pixels(placed: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """scale_skeleton of pixels (r, c, radius)."""
    rows, cols = target[0] / source[0], target[1] / source[1]
    moved = placed.select(
        F.least(F.rint(F.col("r") * rows).cast("int"), F.lit(target[0] - 1)).alias("r"), F.least(F.rint(F.col("c") * cols).cast("int"), F.lit(target[1] - 1)).alias("c"),
        (F.col("radius") * ((rows + cols) / 2)).alias("radius"),
    )
    return moved.groupBy("r", "c").agg(F.max("radius").alias("radius"))
