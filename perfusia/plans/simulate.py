"""Whole runs: presets, chunks of steps with a frame each, building a domain from vessel geometry, coupling to the tissue."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfusia.operators import flow, network, raster, runs, scaling, skeleton, tissue, transport
from perfusia.operators.iterate import run_steps
from perfusia.operators.stencil import StepParams
from perfusia.sources import storage
from perfusia.sources.scratch import Scratch


def reaction_diffusion(cells: DataFrame, steps: int, dt: float, dx: float = 1.0, dy: float = 1.0, engine: str = "auto") -> DataFrame:
    """Preset: carbon dioxide at 0.8 of oxygen's diffusivity, none in vessels, yield 1, vessels reset."""
    cells = cells.withColumns({"d_co2": F.col("d_o2") * 0.8, "vessel_co2": F.lit(0.0)})
    return run_steps(cells, StepParams(dt, dx, dy), steps, engine)


@dataclass(frozen=True)
class Frame:
    frame_id: int
    time: float
    cells: DataFrame

    def overlay(self) -> DataFrame:
        return tissue.overlay_frame(self.cells).select(F.lit(self.frame_id).alias("frame_id"), F.lit(self.time).alias("time"), "*")


def frames(cells: DataFrame, params: StepParams, chunks: int, steps_per_chunk: int, engine: str = "auto") -> Iterator[Frame]:
    """The state after each chunk of steps, each a durable table."""
    scratch = Scratch(cells.sparkSession, "frames")
    for i in range(chunks):
        cells = scratch.keep(run_steps(cells, params, steps_per_chunk, engine))
        yield Frame(i, (i + 1) * steps_per_chunk * params.dt, cells)


def save_frames(found: Iterator[Frame], folder: str) -> None:
    """A Parquet partition a frame; writing a frame again replaces it."""
    for f in found:
        f.overlay().drop("frame_id").write.mode("overwrite").parquet(f"{folder}/frame_id={f.frame_id}")


def reconstruct_mask(bones: DataFrame, height: int, width: int) -> DataFrame:
    """Union of disks of the local radius around skeleton pixels (r, c, radius). Pixels of a band of rows are drawn together, so that a shuffle moves
    each once and then what their disks are together, not the rows of every disk."""
    bones = scaling.banded(bones)
    point = F.array(F.struct(F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y")))
    segments = bones.select(F.monotonically_increasing_id().alias("segment_id"), point.alias("centerline"), F.array("radius").alias("radii"))
    return raster.vessel_mask(segments, height, width)


def domain_from_structure(name: str, folder: str, mask: DataFrame, bones: DataFrame, distance: DataFrame, nodes: DataFrame, edges: DataFrame, source: tuple[int, int], shape: tuple[int, int]) -> dict[str, DataFrame]:
    """Scales extracted geometry, rebuilds the vessel mask at the grid's resolution, saves all parts and gives the cells, scaled nodes and edges."""
    scratch = Scratch(mask.sparkSession, "domain")
    placed = scratch.keep(scaling.banded(scaling.with_distance(bones, distance)))
    scaled = scratch.keep(scaling.scaled_pixels(placed, source, shape))
    simulation_mask = scratch.keep(raster.fit_mask(reconstruct_mask(scaled, *shape), *shape))
    parts = {
        "raw_mask": mask, "skeleton": bones, "distance_map": distance, "reconstructed_mask": reconstruct_mask(placed, *source),
        "scaled_skeleton": scaled.select("r", "c"), "scaled_distance_map": scaled, "simulation_mask": simulation_mask, "nodes": nodes, "edges": edges,
        "scaled_nodes": scaling.scale_nodes(nodes, source, shape), "scaled_edges": scaling.scale_edges(edges, source, shape),
    }
    storage.save_geometry(parts, f"{folder}/{name.lower().replace(' ', '_')}_geometry")
    # Porosity, tortuosity, viscosity and consumption of the preset tissue.
    cells = tissue.set_uniform_properties(tissue.dense_grid(mask.sparkSession, *shape), 0.3, 2.0, 0.001)
    cells = tissue.set_vessel_mask(cells, simulation_mask.select(F.col("y").alias("r"), F.col("x").alias("c")), 1.0)
    return {"cells": tissue.with_diffusivities(tissue.set_uniform_consumption(cells, 0.05, 0.05)), "nodes": parts["scaled_nodes"], "edges": parts["scaled_edges"]}


def vessel_coupling(bones: DataFrame, nodes: DataFrame, edges: DataFrame, reconstruction: DataFrame, height: int, width: int, inlet_mmhg: float = 35.0, outlet_mmhg: float = 15.0) -> dict[str, DataFrame]:
    """From geometry to source maps: centerlines, network, boundary pixels, flow, concentrations, sources and their summary."""
    scratch = Scratch(nodes.sparkSession, "coupling")
    nodes, edges = scratch.keep(nodes), scratch.keep(edges)
    lines = skeleton.edge_centerlines(bones, nodes, edges, height, width, on_missing="drop")
    own_nodes, segments = map(scratch.keep, network.network_from_tables(nodes, edges, lines, min_length=0.0, min_radius=0.0))
    boundary = raster.reconstructed_boundary_runs(segments, reconstruction, height, width)
    labels = scratch.keep(network.component_labels(own_nodes, segments))
    ends = network.pressure_boundary_nodes(own_nodes, segments, labels)
    fixed = ends.select(F.explode(F.array(F.struct(F.col("inlet").alias("node_id"), F.lit(inlet_mmhg).alias("pressure_mmhg")), F.struct(F.col("outlet").alias("node_id"), F.lit(outlet_mmhg).alias("pressure_mmhg")))).alias("f")).select("f.*")
    pressures, flows = flow.solve_network_flow_mmhg(own_nodes, segments, scratch.keep(fixed), labels=labels)
    sources = transport.boundary_source_maps(height, width, boundary, transport.flow_weighted_concentrations(flows))
    return {"segments": segments, "boundary": runs.pixels(boundary, ("segment_id", "y")), "pressures": pressures, "flows": flows, "sources": sources, "summary": transport.summarize_sources(sources, height, width)}


def timing_summary(runs: DataFrame) -> DataFrame:
    """runs (label, seconds): mean, sample deviation, least and most of each label, and how many times faster than the slowest mean."""
    stats = runs.groupBy("label").agg(F.avg("seconds").alias("mean"), F.stddev_samp("seconds").alias("std"), F.min("seconds").alias("min"), F.max("seconds").alias("max"))
    slowest = stats.agg(F.max("mean").alias("slowest"))
    return stats.join(F.broadcast(slowest)).withColumn("speedup", F.col("slowest") / F.col("mean")).drop("slowest")


def largest_error(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Largest absolute difference of each field over cells (r, c) of two grids."""
    both = a.select("r", "c", *fields).join(b.select("r", "c", *[F.col(f).alias(f"_{f}") for f in fields]), ["r", "c"], "full")
    return both.agg(*[F.max(F.abs(F.col(f) - F.col(f"_{f}"))).alias(f) for f in fields])


