"""The reference's test cases as data, invariants, error cases and both engines against each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perfusia.functions import scalars, species
from perfusia.operators import flow, iterate, network, raster, scaling, skeleton, stencil, tissue, transport
from perfusia.operators.components import components, contracted
from perfusia.operators.stencil import StepParams
from perfusia.plans import simulate
from perfusia.sources import storage
from perfusia.sources.scratch import Scratch

P = StepParams(dt=0.1)


def grid(spark, rows, cols, **columns):
    cells = tissue.dense_grid(spark, rows, cols)
    defaults = {"o2": 0.0, "co2": 0.0, "vmax": 0.0, "km": 1.0, "d_o2": 1.0, "d_co2": 1.0} | columns
    return cells.withColumns({k: v if not isinstance(v, (int, float, bool)) else F.lit(v) for k, v in defaults.items()})


def random_arrays(rows, cols, seed=42):
    rng = np.random.default_rng(seed)
    vessel = np.zeros((rows, cols), bool)
    for r, c in ((2, 2), (5, 7), (8, 4)):
        vessel[r : r + 2, c : c + 2] = True
    d = rng.uniform(0.8, 1.2, (rows, cols))
    one = np.ones((rows, cols))
    return {"o2": rng.uniform(0.5, 10, (rows, cols)), "co2": rng.uniform(0, 2, (rows, cols)), "d_o2": d, "d_co2": d * 0.8, "vmax": one * 0.5, "km": one, "vessel": vessel, "vessel_o2": vessel * 10.0, "vessel_co2": one * 0}


def plain_step(f, p):
    """Cell by cell."""
    rows, cols = f["o2"].shape
    out = {"o2": f["o2"].copy(), "co2": f["co2"].copy()}
    for r in range(rows):
        for c in range(cols):
            used = 0.0 if f["vessel"][r, c] else f["vmax"][r, c] * max(f["o2"][r, c], 0) / (f["km"][r, c] + max(f["o2"][r, c], 0))
            for s, made in (("o2", -used), ("co2", p.co2_yield * used)):
                flux = 0.0
                for i, j, h in ((r, c - 1, p.dx), (r, c + 1, p.dx), (r - 1, c, p.dy), (r + 1, c, p.dy)):
                    if 0 <= i < rows and 0 <= j < cols:
                        flux += 0.5 * (f[f"d_{s}"][i, j] + f[f"d_{s}"][r, c]) * (f[s][i, j] - f[s][r, c]) / h**2
                out[s][r, c] += p.dt * (flux + made)
            if p.reset and f["vessel"][r, c]:
                out["o2"][r, c], out["co2"][r, c] = f["vessel_o2"][r, c], f["vessel_co2"][r, c]
    return f | out


def test_golden_step_and_engines_agree(spark):
    f = random_arrays(12, 11)
    cells, p = storage.cells_from_arrays(spark, f), StepParams(0.05, dx=1.0, dy=2.0)
    want = f
    for _ in range(5):
        want = plain_step(want, p)
    for got in (iterate.run_steps(cells, p, 5, "windows"), iterate.steps_by_bands(cells, p, 5, band=4, halo=3)):
        back = storage.arrays_from_cells(got, ["o2", "co2"])
        assert np.allclose(back["o2"], want["o2"], atol=1e-9) and np.allclose(back["co2"], want["co2"], atol=1e-9)


def test_uniform_grid_stays(spark):
    got = stencil.gas_exchange_step(grid(spark, 5, 5, o2=1.0), P).agg(F.max(F.abs(F.col("o2") - 1)), F.max(F.abs("co2"))).first()
    assert max(got) < 1e-6


def test_consumption_closed_form(spark):
    got = stencil.gas_exchange_step(grid(spark, 3, 3, o2=5.0, co2=1.0, d_o2=0.0, d_co2=0.0, vmax=0.5), P).first()
    assert abs(got.o2 - (5 - 0.1 * 2.5 / 6)) < 1e-9 and abs(got.co2 - (1 + 0.1 * 2.5 / 6)) < 1e-9


def test_vessels_reset_only_when_asked(spark):
    cells = grid(spark, 3, 3, o2=1.0, co2=2.0, vessel=(F.col("r") == 1) & (F.col("c") == 1), vessel_o2=5.0)
    centre = lambda p: stencil.gas_exchange_step(cells, p).where("vessel").first()
    assert (centre(P).o2, centre(P).co2) == (5.0, 0.0) and (centre(StepParams(0.1, reset=False)).o2, centre(StepParams(0.1, reset=False)).co2) == (1.0, 2.0)


def test_mass_is_conserved(spark):
    cells = storage.cells_from_arrays(spark, random_arrays(12, 11))
    p = StepParams(0.05, reset=False)
    total = lambda df: df.agg(F.sum("o2"), F.sum(F.col("o2") + F.col("co2"))).first()
    still, moved = cells.withColumn("vmax", F.lit(0.0)), iterate.run_steps(cells.withColumn("vmax", F.lit(0.0)), p, 4)
    assert abs(total(still)[0] - total(moved)[0]) < 1e-8 and abs(total(cells)[1] - total(iterate.run_steps(cells, p, 4))[1]) < 1e-8
    bounds = lambda df: df.agg(F.min("o2"), F.max("o2")).first()
    assert p.stable(1.2) and bounds(still)[0] <= bounds(moved)[0] and bounds(moved)[1] <= bounds(still)[1]


def test_no_steps_and_bad_calls(spark):
    cells = storage.cells_from_arrays(spark, random_arrays(4, 4))
    assert simulate.largest_error(cells, iterate.run_steps(cells, P, 0), ["o2"]).first()[0] == 0
    with pytest.raises(ValueError):
        iterate.steps_by_bands(cells, P, 2, band=2, halo=3)
    with pytest.raises(ValueError):
        iterate.run_steps(cells, P, 1, "other")
    with pytest.raises(ValueError):
        storage.cells_from_arrays(spark, {"a": np.zeros((2, 2)), "b": np.zeros((2, 3))})
    with pytest.raises(ValueError):
        tissue.dense_grid(spark, 0, 3)
    with pytest.raises(ValueError, match="too many"):
        storage.arrays_from_cells(storage.cells_from_arrays(spark, {"a": np.zeros((2, 3))}), ["a"], most=5)


def test_species(spark):
    assert {r.name: r.free_diffusivity for r in species.species_table(spark).collect()} == {"Oxygen": 2.0e-9, "Carbon Dioxide": 1.6e-9}
    with pytest.raises(NotImplementedError):
        species.Species("x", 1.0).free_diffusivity(None, None)


def test_case_round_trip(spark, tmp_path):
    f = random_arrays(5, 6)
    cells = storage.cells_from_arrays(spark, f)
    storage.write_cases(cells, str(tmp_path / "case"), 0.1)
    back = storage.read_case(spark, str(tmp_path / "case"))
    assert np.allclose(storage.arrays_from_cells(back, ["o2"])["o2"], f["o2"]) and back.first().dt == 0.1


def simple_network(spark, edges, places):
    nodes = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in places.items()], "node_id long, row double, col double")
    table = spark.createDataFrame([(k, a, b, float(n), float(r)) for k, (a, b, n, r) in enumerate(edges)], "edge_id long, start_node long, end_node long, length_px double, mean_radius double")
    return network.network_from_tables(nodes, table, min_length=0.0, min_radius=0.0)


Y = ([(0, 1, 20, 2), (1, 2, 20, 2), (1, 3, 20, 2), (4, 5, 20, 2)], {0: (10, 0), 1: (10, 20), 2: (0, 40), 3: (20, 40), 4: (40, 0), 5: (40, 20), 6: (50, 50)})


def test_flow_on_a_branch(spark):
    nodes, segments = simple_network(spark, *Y)
    fixed = spark.createDataFrame([(0, 35.0), (2, 15.0), (3, 15.0)], "node_id long, pressure_mmhg double")
    for dense in (2000, 0):
        pressures, flows = flow.solve_network_flow_mmhg(nodes, segments, fixed, dense=dense)
        mmhg = {r.node_id: r.pressure / scalars.PASCAL_PER_MMHG for r in pressures.collect()}
        assert set(mmhg) == {0, 1, 2, 3} and abs(mmhg[1] - (35 + 15 + 15) / 3) < 1e-6
        q = {r.segment_id: r.flow_m3_per_s for r in flows.collect()}
        assert abs(q[0] - q[1] - q[2]) < 1e-9 * abs(q[0]) and abs(q[1] - q[2]) < 1e-9 * abs(q[0])
    with pytest.raises(ValueError):
        flow.solve_network_flow_mmhg(nodes, segments, fixed.limit(1))
    flat, none = flow.solve_network_flow_mmhg(nodes, segments, spark.createDataFrame([(0, 35.0), (4, 15.0)], fixed.schema))
    assert {r.node_id: round(r.pressure / scalars.PASCAL_PER_MMHG, 6) for r in flat.collect()} == {0: 35.0, 1: 35.0, 2: 35.0, 3: 35.0, 4: 15.0, 5: 15.0}
    assert none.agg(F.max(F.abs("flow_m3_per_s"))).first()[0] < 1e-20


def dense_pressures(edges, fixed):
    """Pressures by one dense system; edges (a, b, g)."""
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    at = {n: i for i, n in enumerate(nodes)}
    matrix, right = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
    for a, b, g in edges:
        for x, y in ((at[a], at[b]), (at[b], at[a])):
            matrix[x, x] += g
            matrix[x, y] -= g
    for n, p in fixed.items():
        matrix[at[n]] = 0
        matrix[at[n], at[n]], right[at[n]] = 1, p
    return dict(zip(nodes, np.linalg.solve(matrix, right)))


def sheet(h, w, rng):
    places = {r * w + c: (r * 10, c * 10) for r in range(h) for c in range(w)}
    pairs = [(i, i + 1) for i in places if (i + 1) % w] + [(i, i + w) for i in places if i + w < h * w]
    return [(a, b, float(rng.uniform(10, 50)), float(rng.uniform(1, 3))) for a, b in pairs], places


def expander(n, degree, rng):
    pairs = sorted({(min(a, b), max(a, b)) for _ in range(degree // 2) for a, b in zip(range(n), rng.permutation(n).tolist()) if a != b} | {(i, i + 1) for i in range(n - 1)})
    return [(a, b, 10.0, float(rng.uniform(1, 2))) for a, b in pairs], {i: (0, 0) for i in range(n)}


@pytest.mark.parametrize(("kind", "dense", "fixed", "iterates"), [("sheet", 60, {0: 35.0, 599: 15.0}, False), ("sheet", 25, {3: 35.0, 590: 15.0, 300: 22.0}, True), ("hub", 60, {0: 35.0, 599: 15.0}, False), ("expander", 30, {0: 35.0, 1: 15.0, 7: 20.0}, True)])
def test_large_components_are_decomposed(spark, monkeypatch, kind, dense, fixed, iterates):
    """Conjugate gradients take over only where the interface is too large for a task: separators wider than that, or none."""
    rng = np.random.default_rng(dense)
    edges, places = expander(240, 8, rng) if kind == "expander" else sheet(20, 30, rng)
    if kind == "hub":  # one node linked to a third of all, another with many fixed neighbours
        edges += [(700, n, 10.0, 1.0) for n in range(1, 599, 3)] + [(701, n, 12.0, 1.0) for n in range(800, 900)] + [(700, 701, 10.0, 2.0)]
        places |= {n: (0, 0) for n in (700, 701, *range(800, 900))}
        fixed = fixed | {n: 20.0 + n / 100 for n in range(800, 900)}
    nodes, segments = simple_network(spark, edges, places)
    ran = []
    whole = flow.conjugate_gradient
    monkeypatch.setattr(flow, "conjugate_gradient", lambda *a: ran.append(1) or whole(*a))
    pressures, flows = flow.solve_network_flow_mmhg(nodes, segments, spark.createDataFrame(list(fixed.items()), "node_id long, pressure_mmhg double"), dense=dense)
    got = {r.node_id: r.pressure / scalars.PASCAL_PER_MMHG for r in pressures.collect()}
    want = dense_pressures([(a, b, r**4 / n) for a, b, n, r in edges], fixed)
    assert got.keys() == want.keys() and max(abs(got[n] - want[n]) for n in want) < 1e-8
    assert bool(ran) == iterates
    assert flows.count() == len(edges)


def test_a_part_amounts_to_its_schur_complement():
    from perfusia.operators.dissect import Inside

    rng = np.random.default_rng(1)
    g = np.triu(rng.random((9, 9)) * (rng.random((9, 9)) < 0.6), 1)
    rows = [(a, b, b < 6, g[a, b], 0.0) for a in range(6) for b in range(a + 1, 9) if g[a, b]] + [(2, None, False, 0.5, 10.0)]
    made = Inside.of(pd.DataFrame(rows, columns=["a", "b", "inner", "g", "right"]).assign(part=0)).amounts_to()
    full = -(g + g.T)
    full[6:, 6:] = 0
    np.fill_diagonal(full, -full.sum(1))
    full[2, 2] += 0.5
    schur = full[6:, 6:] - full[6:, :6] @ np.linalg.solve(full[:6, :6], full[:6, 6:])
    right = -full[6:, :6] @ np.linalg.solve(full[:6, :6], np.eye(6)[2] * 10.0)
    links = made[made.b.notna()]
    assert all(abs(schur[a - 6, b - 6] + v) < 1e-12 for a, b, v in zip(links.a, links.b.astype(int), links.g))
    ground = made[made.b.isna()].set_index("a")
    assert np.allclose(ground.right.reindex([6, 7, 8]).fillna(0), right) and np.allclose(ground.g.reindex([6, 7, 8]).fillna(0), schur.sum(1))


def test_a_product_moves_the_vector_alone(spark):
    from perfusia.sources.scratch import Scratch

    matrix = Scratch(spark, "matrix").bucketed(spark.range(1000).selectExpr("id as row", "id % 97 as col", "1.0D as value"), "col")
    vector = spark.range(97).selectExpr("id as col", "id * 1.0D as u")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = matrix.join(vector, "col")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_a_segment_without_radius_stops_the_flow(spark):
    nodes, segments = simple_network(spark, [(0, 1, 20, 2), (2, 3, 20, 0)], {i: (i, i) for i in range(4)})
    with pytest.raises(Exception, match="positive"):
        flow.solve_network_flow_mmhg(nodes, segments, spark.createDataFrame([(0, 1.0), (1, 2.0)], "node_id long, pressure_mmhg double"))


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_contraction_keeps_components(spark, chunk):
    rng = np.random.default_rng(3)
    ends = rng.integers(-400, 400, (260, 2)).tolist() + [[500, k] for k in range(501, 560)] + [[k, k + 1] for k in range(900, 960)] + [[7, 7], [None, 3], [4, None]]
    ends += ends[:20]
    least = {}

    def top(x):
        least.setdefault(x, x)
        while least[x] != x:
            x = least[x]
        return x

    for a, b in ends:
        if a is not None and b is not None and a != b:
            p, q = sorted((top(a), top(b)))
            least[q] = p
    edges = spark.createDataFrame([tuple(e) for e in ends], "a long, b long")
    stars = contracted(edges, chunk, 64)
    assert stars.count() <= len(ends)
    assert {r.node: r.component for r in components(stars, Scratch(spark, "test")).collect()} == {x: top(x) for x in least}
    assert contracted(edges.where("false")).count() == 0


def test_network_measures(spark):
    nodes, segments = simple_network(spark, [*Y[0], (6, 6, 5, 1)], Y[1])
    assert {r.node_id for r in network.endpoint_nodes(nodes, segments).collect()} == {0, 2, 3, 4, 5}
    assert {r.node_id: r.neighbors for r in network.neighbor_map(nodes, segments).collect()}[1] == [0, 2, 3]
    ends = network.pressure_boundary_nodes(nodes, segments).first()
    assert (ends.inlet, ends.outlet, ends.size) == (0, 2, 4)
    network.validate(nodes, segments)
    with pytest.raises(ValueError):
        network.validate(nodes.where("node_id <> 3").union(nodes.where("node_id = 2")), segments)
    with pytest.raises(Exception, match="fewer than two"):
        network.pressure_boundary_nodes(nodes.where("node_id = 6"), segments.where("false")).collect()


def test_rasters_against_arrays(spark):
    _, segments = simple_network(spark, *Y)
    h, w = 30, 45
    cells = [(r.y, r.x, r.radius) for r in raster.centerline_pixels(segments, h, w).collect()]
    yy, xx = np.mgrid[:h, :w]
    disk = np.any([(yy - y) ** 2 + (xx - x) ** 2 <= rad**2 for y, x, rad in cells], axis=0)
    found = raster.vessel_mask(segments, h, w)
    assert {(r.y, r.x) for r in found.collect()} == set(zip(*map(lambda v: v.tolist(), np.nonzero(disk))))
    padded = np.pad(disk, 1)
    inner = np.all([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
    edge = raster.boundary_mask(found)
    assert {(r.y, r.x) for r in edge.collect()} == set(zip(*map(lambda v: v.tolist(), np.nonzero(disk & ~inner))))
    points = raster.centerline_pixels(segments, h, w).orderBy("segment_id", "pos").collect()
    want = {(r.y, r.x): min(points, key=lambda p: ((p.y - r.y) ** 2 + (p.x - r.x) ** 2, p.segment_id, p.pos)).segment_id for r in edge.collect()}
    near = raster.nearest_points(edge, raster.centerline_pixels(segments, h, w), tall=4)
    assert {(r.y, r.x): r.segment_id for r in near.collect()} == want
    shell = {(r.y, r.x) for r in raster.exchange_mask(segments, h, w).collect()}
    ring = {(r.y, r.x) for r in raster.exchange_pixel_map(segments, h, w).collect()}
    assert shell <= ring and not shell & {(r.y, r.x) for r in found.collect()}


def test_source_maps(spark):
    pixels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 0, 1), (2, 0, 1), (2, 9, 9), (3, 5, 5)], "segment_id long, y int, x int")
    known = spark.createDataFrame([(1, 1.0, -0.5), (2, 2.0, -1.0), (7, 9.0, 9.0)], "segment_id long, oxygen double, carbon_dioxide double")
    maps = {(r.y, r.x): (r.oxygen, r.carbon_dioxide) for r in transport.boundary_source_maps(6, 6, pixels, known).collect()}
    assert maps == {(0, 0): (1.0, -0.5), (0, 1): (3.0, -1.5), (5, 5): (2.0, -1.0)}
    shared = {(r.y, r.x): r.oxygen for r in transport.boundary_source_maps(6, 6, pixels, known, remap=False, normalize=True).collect()}
    assert shared == {(0, 0): 1 / 3, (0, 1): 1 / 3 + 1.0}
    last = {(r.y, r.x): r.oxygen for r in transport.boundary_concentration_maps(6, 6, pixels, known).collect()}
    assert last[0, 1] == 2.0
    s = transport.summarize_sources(transport.boundary_source_maps(6, 6, pixels, known), 6, 6).first()
    assert (s.oxygen_max, s.carbon_dioxide_max, s.carbon_dioxide_min) == (3.0, 0.0, -1.5)
    dense = transport.densify(transport.boundary_source_maps(6, 6, pixels, known), 6, 6)
    assert dense.count() == 36


def test_flow_weights_without_flow(spark):
    still = spark.createDataFrame([(1, 0.0), (2, 0.0)], "segment_id long, flow_m3_per_s double")
    assert {(r.oxygen, r.carbon_dioxide) for r in transport.flow_weighted_concentrations(still).collect()} == {(0.15, -0.15)}
    assert transport.flow_weighted_concentrations(still.limit(0)).count() == 0


def test_traced_paths_are_those_of_a_queue(spark):
    from collections import deque

    rng = np.random.default_rng(3)
    image = rng.random((9, 12)) < 0.6
    image[0, 0] = image[8, 11] = image[0, 11] = True
    bones = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(image))], "r int, c int")
    ends = [(0, 0, 0, 8, 11), (1, 0, 0, 0, 0), (2, 0, 11, 8, 11)]

    def queue_path(a, b):
        parents, todo = {a: None}, deque([a])
        while todo:
            at = todo.popleft()
            if at == b:
                break
            for dr, dc in skeleton.STEPS:
                n = at[0] + dr, at[1] + dc
                if 0 <= n[0] < 9 and 0 <= n[1] < 12 and image[n] and n not in parents:
                    parents[n] = at
                    todo.append(n)
        if b not in parents:
            return None
        path = [b]
        while parents[path[-1]] is not None:
            path.append(parents[path[-1]])
        return path[::-1]

    got = {}
    for r in skeleton.trace_paths(bones, spark.createDataFrame(ends, "edge_id int, sr int, sc int, er int, ec int"), on_missing="drop").orderBy("edge_id", "pos").collect():
        got.setdefault(r.edge_id, []).append((r.r, r.c))
    assert got == {e: p for e, a, b, c, d in ends if (p := queue_path((a, b), (c, d)))}
    with pytest.raises(ValueError):
        skeleton.trace_paths(spark.createDataFrame([(0, 0), (5, 5)], "r int, c int"), spark.createDataFrame([(0, 0, 0, 5, 5)], "edge_id int, sr int, sc int, er int, ec int"))
    with pytest.raises(Exception, match="no skeleton pixel"):
        skeleton.nearest_skeleton_pixel(spark.createDataFrame([(1, 50.0, 50.0)], "id int, row double, col double"), bones, 60, 60).collect()


def test_structure_and_coupling_end_to_end(spark, tmp_path):
    bones = spark.createDataFrame([(10, c) for c in range(0, 41)], "r int, c int")
    distance = bones.withColumn("radius", F.lit(2.0))
    nodes = spark.createDataFrame([(0, 10.0, 0.0, 1.0), (1, 10.0, 20.0, 2.0), (2, 10.0, 40.0, 1.0)], "node_id long, row double, col double, node_type double")
    edges = spark.createDataFrame([(0, 0, 1, 20.0, 2.0, 1.0, 3.0, 0.5), (1, 1, 2, 20.0, 2.0, 1.0, 3.0, 0.5)], "edge_id long, start_node long, end_node long, length_px double, mean_radius double, min_radius double, max_radius double, normalized_radius double")
    mask = raster.boundary_mask(simulate.reconstruct_mask(distance, 21, 41))
    found = simulate.domain_from_structure("My Vessel", str(tmp_path), mask, bones, distance, nodes, edges, (21, 41), (42, 82))
    assert found["cells"].count() == 42 * 82 and found["cells"].where("vessel and vmax > 0").count() == 0 and (tmp_path / "my_vessel_geometry" / "scaled_nodes").exists()
    assert found["edges"].first().length_px == 40.0 and scaling.scale_nodes(nodes, (21, 41), (42, 82)).first().row == 20.0
    out = simulate.vessel_coupling(bones, nodes, edges, simulate.reconstruct_mask(distance, 21, 41), 21, 41)
    mmhg = sorted(round(r.pressure / scalars.PASCAL_PER_MMHG, 6) for r in out["pressures"].collect())
    assert mmhg == [15.0, 25.0, 35.0] and out["summary"].first().oxygen_max == 1.0


def test_frames_and_stream(spark, tmp_path):
    from perfusia.streaming.frames import stream_frames

    cells = storage.cells_from_arrays(spark, random_arrays(10, 10))
    found = list(simulate.frames(cells, StepParams(0.05), 2, 2))
    assert [f.time for f in found] == [0.1, 0.2]
    simulate.save_frames(iter(found), str(tmp_path / "batch"))
    ticks = tmp_path / "ticks"
    for i in range(2):
        spark.range(1).coalesce(1).write.parquet(str(ticks / f"{i}"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(ticks))
    q = stream_frames(spark, stream, cells.select("r", "c", *iterate.STATE, *iterate.STATIC), StepParams(0.05), 2, str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    a, b = (spark.read.parquet(str(tmp_path / x)).where("frame_id = 1") for x in ("batch", "out/frames"))
    assert a.count() == 100 and simulate.largest_error(a, b, ["red", "alpha"]).first()[0] < 1e-12


@pytest.mark.parametrize("tall", [1, 3, None])
def test_the_distance_transform_finds_owners_at_any_distance(spark, tall):
    """Few points, far apart, several in a pixel and at equal distances, targets in bands and columns without any."""
    rng = np.random.default_rng(11)
    points = [(int(y), int(x), int(s), int(p)) for y, x, s, p in zip(rng.integers(0, 30, 40) * 2, rng.choice([3, 4, 9, 30], 40), rng.integers(0, 9, 40), range(40))]
    targets = [(int(y), int(x)) for y, x in rng.integers(-5, 70, (300, 2))]
    found = raster.nearest_points(spark.createDataFrame(targets + targets[:9], "y int, x int"), spark.createDataFrame(points, "y int, x int, segment_id long, pos int"), tall)
    want = {(y, x): min(((y - b) ** 2 + (x - a) ** 2, s, p) for b, a, s, p in points)[1] for y, x in targets}
    assert sorted((r.y, r.x, r.segment_id) for r in found.collect()) == sorted((y, x, s) for (y, x), s in want.items())
    none = spark.createDataFrame([], "y int, x int, segment_id long, pos int")
    assert raster.nearest_points(spark.createDataFrame(targets, "y int, x int"), none).count() == 0


def test_nearest_places_with_nine_tenths_in_one_cell(spark):
    from perfusia.operators.nearest import nearest_places

    rng = np.random.default_rng(2)
    crowd = rng.random((1800, 2)) * 1e-3 + 5
    places = np.concatenate([crowd, crowd[:100], rng.random((200, 2)) * 1000]).round(6)
    held = [(k, *map(float, p)) for k, p in enumerate(rng.permutation(places))]
    asked = [(k, *map(float, p)) for k, p in enumerate(np.concatenate([rng.random((300, 2)) * 1e-3 + 5, rng.random((300, 2)) * 1500 - 200, places[:50]]))]
    found = nearest_places(spark.createDataFrame(asked, "lost long, cy double, cx double"), spark.createDataFrame(held, "owner long, cy double, cx double"), task_points=64, task_asked=50, sample=512)
    want = {k: min(((y - b) * (y - b) + (x - a) * (x - a), o) for o, b, a in held)[1] for k, y, x in asked}
    assert {r.lost: r.owner for r in found.collect()} == want
    assert nearest_places(spark.createDataFrame(asked, "lost long, cy double, cx double"), spark.createDataFrame([], "owner long, cy double, cx double")).count() == 0


def test_a_network_fails_where_ids_repeat_or_ends_are_missing(spark):
    nodes = spark.createDataFrame([(i, 0.0, float(i)) for i in (1, 2, 3, 3)], "node_id long, row double, col double")
    edge = lambda *rows: spark.createDataFrame([(*r, 20.0, 2.0) for r in rows], "edge_id long, start_node long, end_node long, length_px double, mean_radius double")
    read = lambda edges: network.network_from_tables(nodes, edges)[1].collect()
    assert len(read(edge((1, 1, 2), (2, 2, 1)))) == 2
    for edges, message in ((edge((1, 1, 9)), "end doesn't exist: 9"), (edge((1, 3, 1)), "node repeats: 3"), (edge((7, 1, 2), (7, 2, 1)), "edge_id repeats: 7")):
        with pytest.raises(Exception, match=message):
            read(edges)
    assert len(network.network_from_tables(nodes, edge((1, 1, 9)), min_length=30.0)[1].collect()) == 0  # of dropped edges nothing is asked


def test_a_stream_that_goes_on_leaves_frames_alone_and_repeats_what_broke_off(spark, tmp_path):
    from perfusia.streaming.frames import stream_frames, ticks_from

    cells = storage.cells_from_arrays(spark, random_arrays(9, 7)).select("r", "c", *iterate.STATE, *iterate.STATIC)
    for i in range(2):
        spark.range(i, i + 1).toDF("chunk").coalesce(1).write.parquet(str(tmp_path / f"ticks/{i}"))
    go = lambda: stream_frames(spark, ticks_from(spark, str(tmp_path / "ticks")), cells, StepParams(0.05), 2, str(tmp_path / "out"), str(tmp_path / "check"), True).awaitTermination()
    read = lambda: sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/frames")).collect()))
    go()
    files, first = sorted((tmp_path / "out/frames").rglob("*.parquet")), read()
    go()
    assert sorted((tmp_path / "out/frames").rglob("*.parquet")) == files and {r[-1] for r in first} == {0, 1}
    (tmp_path / "check/commits/1").unlink()  # as if the driver had gone before it could note the second batch
    for crc in (tmp_path / "check/commits").glob(".1.crc"):
        crc.unlink()
    go()
    assert read() == first and sorted((tmp_path / "out/frames/frame_id=0").glob("*.parquet")) == [f for f in files if "frame_id=0" in str(f)]


@pytest.mark.parametrize(("tile", "halo", "steps"), [(8, 3, 7), (5, 5, 6), (64, 20, 9)])
def test_tiles_step_as_windows_do(spark, tile, halo, steps):
    cells = storage.cells_from_arrays(spark, random_arrays(21, 18))
    a, b = iterate.steps_by_tiles(cells, P, steps, tile, halo), iterate.steps_by_windows(cells, P, steps)
    assert a.count() == 21 * 18 and max(simulate.largest_error(a, b, ["o2", "co2"]).first()) < 1e-12


def test_runs_are_the_sets_of_their_cells(spark):
    from perfusia.operators import runs

    rng = np.random.default_rng(4)
    sets = [[(int(y), int(x), int(x + n)) for y, x, n in zip(rng.integers(0, 12, 60), rng.integers(-5, 40, 60), rng.integers(0, 9, 60))] for _ in range(2)]
    a, b = ({(y, x) for y, x0, x1 in rows for x in range(x0, x1 + 1)} for rows in sets)
    ra, rb = (spark.createDataFrame(rows, "y int, x0 int, x1 int") for rows in sets)
    cells = lambda found: {(r.y, r.x) for r in runs.pixels(found).collect()}
    whole = runs.union(ra)
    held = sorted(map(tuple, whole.collect()))
    assert all(p[0] != q[0] or p[2] + 1 < q[1] for p, q in zip(held, held[1:])) and cells(whole) == a  # apart, also from runs next to them
    assert cells(runs.union(ra, rb)) == a | b and cells(runs.difference(ra, rb)) == a - b and cells(runs.intersection(ra, rb)) == a & b
    inner = {(y, x) for y, x in a if all((y + dy, x + dx) in a for dy in (-1, 0, 1) for dx in (-1, 0, 1))}
    assert cells(runs.eroded(whole)) == inner and cells(runs.boundary(whole)) == a - inner
    assert runs.of_pixels(spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 4)], "y int, x int")).count() == 2
    points = spark.createDataFrame([(1, 20, 20, float(r)) for r in (0, 0.5, 1, 1.5, 2.23606797749979, 5, 7.3)], "segment_id long, y int, x int, radius double")
    for outer, inner in ((F.col("radius"), None), (F.col("radius") + 1, F.col("radius"))):
        got = sorted((r.y, r.x) for r in runs.pixels(runs.disk_runs(points, 26, 25, outer, inner)).collect())
        size = lambda r, k: r + 1 if k is not None else r
        want = sorted((y, x) for r in (0, 0.5, 1, 1.5, 2.23606797749979, 5, 7.3) for y in range(26) for x in range(25) if (d := (y - 20) ** 2 + (x - 20) ** 2) <= size(r, inner) ** 2 and (inner is None or d > r * r))
        assert got == want
