"""Vessel networks: node and segment tables, their checks, measures, components and ends."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfusia.functions import scalars
from perfusia.operators.components import components, contracted
from perfusia.sources.scratch import Scratch

NODES = "node_id bigint, x double, y double"


def network_from_tables(nodes: DataFrame, edges: DataFrame, centerlines: DataFrame | None = None, scale: float = 1.0, min_length: float = 10.0, min_radius: float = 0.5, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, row, col, ..) and edges (edge_id, start_node, end_node, length_px, mean_radius, ..) as a network.

    All nodes stay. Edges below a minimum go; of the rest, repeated ids and ends that aren't nodes fail the query that reads their geometry. A traced centerline (edge_id, points) is used where there is
    one, else a straight one of as many points as the edge has pixels. With `scratch` edges and their ends are written once, for those who read segments several times.
    """
    at = nodes.select("node_id", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    kept = edges.where((F.col("length_px") >= min_length) & (F.col("mean_radius") >= min_radius))
    ends = checked_ends(once(kept.select("edge_id", "start_node", "end_node", "length_px", "mean_radius"), "edge_id"), at)
    ends = scratch.keep(ends) if scratch else ends
    line = scalars.straight_line(*(F.col(x) for x in ("x0", "y0", "x1", "y1", "length_px")))
    if centerlines is not None:
        ends = ends.join(centerlines.select("edge_id", "points"), "edge_id", "left")
        line = F.coalesce("points", line)
    # a length is never null, which spares those who want lengths the line, and reads the ends, which fails if they aren't nodes
    length, places = F.col("length_px").cast("double"), F.col("x0") + F.col("y0") + F.col("x1") + F.col("y1")
    segments = ends.select(
        F.col("edge_id").alias("segment_id"), "start_node", "end_node", line.alias("centerline"), F.array(F.col("mean_radius").cast("double")).alias("radii"),
        F.lit(scale).alias("scale"), F.coalesce(F.when(places.isNotNull(), length), length, F.lit(0.0)).alias("meta_length_px"),
    )
    return at, segments


def network_from_graph(nodes: DataFrame, edges: DataFrame, radius_map: DataFrame, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Generic graphs. Nodes have a `name`, which is their id as a number, and a position under x and y, pos, position or coord, in this
    order of preference; edges have a unique `ord`, two names and points under centerline, pixels, points, path or coords, else run
    straight. A segment's id is its edge's rank by `ord`, from 0; radii are those of the map (r, c, radius) at the rounded, clipped points."""
    has = set(nodes.columns)
    found = [F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))] if {"x", "y"} <= has else []
    found += [F.col(c) for c in ("pos", "position", "coord") if c in has]
    place = F.coalesce(*found) if found else F.lit(None)
    at = nodes.select(F.col("name").cast("long").alias("node_id"), F.when(place.isNull(), F.raise_error(F.lit("node without a position")).cast("struct<x:double,y:double>")).otherwise(place).alias("p"))
    at = at.select("node_id", "p.x", "p.y")
    named = ranked(edges, "ord", "segment_id").withColumns({"start_node": F.col("start_name").cast("long"), "end_node": F.col("end_name").cast("long")})
    ends = checked_ends(named, at).withColumns({"p0": F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), "p1": F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))})
    lines = [F.col(c) for c in ("centerline", "pixels", "points", "path", "coords") if c in edges.columns]
    segments = ends.select("segment_id", "start_node", "end_node", F.coalesce(*lines, F.array("p0", "p1")).alias("centerline"))
    radii = sample_radii(segments, radius_map)
    return at, segments.join(radii, "segment_id", "left").withColumn("scale", F.lit(scale)).withColumn("meta_length_px", F.lit(None).cast("double"))


def once(rows: DataFrame, key: str) -> DataFrame:
    """rows, which fail when read if a key repeats: one aggregation, no job of its own."""
    rest = [c for c in rows.columns if c != key]
    held = rows.groupBy(key).agg(F.count("*").alias("_times"), *[F.first(c).alias(c) for c in rest])
    fails = F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string")))
    return held.select(F.when(F.col("_times") > 1, fails.cast(rows.schema[key].dataType)).otherwise(F.col(key)).alias(key), *rest)


def checked_ends(edges: DataFrame, at: DataFrame) -> DataFrame:
    """edges with the places x0, y0 and x1, y1 of their ends. A place fails when read if the end isn't a node or several nodes have its id."""
    known = at.groupBy("node_id").agg(F.count("*").alias("times"), F.first("x").alias("x"), F.first("y").alias("y"))
    for end, k in (("start_node", 0), ("end_node", 1)):
        fails = F.raise_error(F.concat(F.when(F.col("times").isNull(), F.lit("end doesn't exist: ")).otherwise(F.lit("node repeats: ")), F.col(end).cast("string"))).cast("double")
        edges = edges.join(known.withColumnRenamed("node_id", end), end, "left")
        good = F.col("times") == 1
        edges = edges.withColumns({f"{c}{k}": F.when(good, F.col(c)).otherwise(fails) for c in ("x", "y")}).drop("times", "x", "y")
    return edges


def ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with their rank from 0 by a unique column: ranges are sorted apart and moved by the counts of those before, a number a task."""
    scratch = Scratch(rows.sparkSession, "ranks")
    dealt = scratch.keep(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    counts = dict(sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect()))
    before = dict(zip(counts, accumulate(counts.values(), initial=0)))
    moved = F.create_map(*[F.lit(x).cast("long") for k, n in before.items() for x in (k, n)]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.withColumn(name, place + moved[F.col("_range").cast("long")]).drop("_range")


def sample_radii(segments: DataFrame, radius_map: DataFrame) -> DataFrame:
    """segment_id, radii: the map's radius at each centerline point, rounded half to even and clipped to the map."""
    bounds = radius_map.agg(F.max("r").alias("rmax"), F.max("c").alias("cmax"))
    points = segments.select("segment_id", F.posexplode("centerline").alias("pos", "p")).join(F.broadcast(bounds))
    clip = lambda x, top: F.least(F.greatest(F.rint(x).cast("int"), F.lit(0)), F.col(top))
    points = points.select("segment_id", "pos", clip(F.col("p.y"), "rmax").alias("r"), clip(F.col("p.x"), "cmax").alias("c"))
    looked = points.join(radius_map.select("r", "c", "radius"), ["r", "c"], "left").withColumn("radius", F.coalesce("radius", F.lit(0.0)))
    return looked.groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("pos", "radius"))).alias("x")).select("segment_id", F.col("x.radius").alias("radii"))


def violations(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(problem, id): node and segment ids that repeat and ends that don't exist."""
    repeat = lambda df, key, what: df.groupBy(key).count().where("count > 1").select(F.lit(what).alias("problem"), F.col(key).alias("id"))
    ends = incidence(segments).select("node_id", "segment_id")
    lost = ends.join(nodes.select("node_id"), "node_id", "left_anti").select(F.lit("end doesn't exist").alias("problem"), F.col("segment_id").alias("id"))
    return repeat(nodes, "node_id", "node repeats").union(repeat(segments, "segment_id", "segment repeats")).union(lost.distinct())


def validate(nodes: DataFrame, segments: DataFrame) -> None:
    """An eager check, for those who want to know before they go on."""
    if found := violations(nodes, segments).limit(5).collect():
        raise ValueError("; ".join(f"{r.problem}: {r.id}" for r in found))


def invalid_segments(segments: DataFrame) -> DataFrame:
    """(segment_id, problem) of segments without points, with radii that fit neither the segment nor its points, or a negative radius."""
    points, radii = F.coalesce(F.size("centerline"), F.lit(0)), F.coalesce(F.size("radii"), F.lit(0))
    checks = {
        "no points": points < 1,
        "radii are neither one nor one a point": (radii != 1) & (radii != points),
        "radius is negative": F.coalesce(F.exists("radii", lambda x: x.isNull() | (x < 0)), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(wrong, F.lit(problem)) for problem, wrong in checks.items()]))
    return segments.select("segment_id", F.explode(found).alias("problem"))


def drawable_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    for end in ("start_node", "end_node"):
        edges = edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return edges


def measured(segments: DataFrame) -> DataFrame:
    """Adds length and radius in pixels and micrometres, cross section, surface and volume."""
    length = F.coalesce("meta_length_px", scalars.centerline_length(F.col("centerline")))
    s = segments.withColumns({"length_px": length, "mean_radius_px": scalars.mean_of(F.col("radii"))})
    s = s.withColumns({"length_um": F.col("length_px") * F.col("scale"), "mean_radius_um": F.col("mean_radius_px") * F.col("scale")})
    r, n = F.col("mean_radius_um"), F.col("length_um")
    return s.withColumns({"cross_section_um2": scalars.cross_sectional_area(r), "surface_um2": scalars.surface_area(r, n), "volume_um3": scalars.volume(r, n)})


def totals(segments: DataFrame) -> DataFrame:
    m = measured(segments)
    return m.agg(F.count("*").alias("segments"), F.coalesce(F.sum("length_um"), F.lit(0.0)).alias("total_length_um"), F.coalesce(F.sum("volume_um3"), F.lit(0.0)).alias("total_volume_um3"))


def incidence(segments: DataFrame) -> DataFrame:
    """(node_id, segment_id, other): both orientations of each segment; a self-loop has two rows."""
    ends = F.explode(F.array(F.struct(F.col("start_node").alias("node_id"), F.col("end_node").alias("other")), F.struct(F.col("end_node").alias("node_id"), F.col("start_node").alias("other"))))
    return segments.select("segment_id", ends.alias("e")).select("e.node_id", "segment_id", "e.other")


def degrees(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    counted = incidence(segments).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.join(counted, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def endpoint_nodes(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    return degrees(nodes, segments).where("degree = 1")


def neighbor_map(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """node_id, neighbors: sorted set; isolated nodes have an empty one."""
    near = incidence(segments).groupBy("node_id").agg(F.sort_array(F.collect_set("other")).alias("neighbors"))
    return nodes.select("node_id").join(near, "node_id", "left").select("node_id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def connected_segments(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, segment_id) of the segments at the given nodes; a self-loop once."""
    return incidence(segments).join(nodes.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "segment_id").distinct()


def component_labels(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node reachable; isolated nodes are their own."""
    linked = components(contracted(segments.select(F.col("start_node").alias("a"), F.col("end_node").alias("b"))), Scratch(nodes.sparkSession, "components"))
    return nodes.select("node_id").join(linked, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def largest_component(nodes: DataFrame, segments: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node_id) of the component with most nodes; of several, that of the smallest node. `labels` are those of component_labels, if known."""
    labels = component_labels(nodes, segments) if labels is None else labels
    first = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return labels.join(F.broadcast(first.select("component")), "component").select("node_id")


def pressure_boundary_nodes(nodes: DataFrame, segments: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row (inlet, outlet, size): the leftmost and rightmost node of the largest component, the smaller id of equals."""
    inside = nodes.join(largest_component(nodes, segments, labels), "node_id")
    ends = inside.agg(F.min_by("node_id", F.struct("x", "node_id")).alias("inlet"), F.max_by("node_id", F.struct(F.col("x"), -F.col("node_id"))).alias("outlet"), F.count("*").alias("size"))
    return ends.select(F.when(F.col("size") < 2, F.raise_error(F.lit("the largest component has fewer than two nodes")).cast("long")).otherwise(F.col("inlet")).alias("inlet"), "outlet", "size")


def flagged_nodes(nodes: DataFrame, flag: str) -> DataFrame:
    """Inlet or outlet nodes (flag is_inlet or is_outlet)."""
    return nodes.where(F.coalesce(F.col(flag), F.lit(False)))
