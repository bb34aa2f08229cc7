"""How much moves: what used to grow faster than the input."""

from __future__ import annotations

import numpy as np
import pytest

from perfusia.operators import extract, flow, raster, runs, skeleton


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture(scope="module")
def drawn(spark):
    """Segments of many points a pixel, across borders of tiles, one without a centerline."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(30):
        (y0, x0), (y1, x1) = rng.random((2, 2)) * (60, 90) - 5
        t = np.linspace(0, 1, 200)
        rows.append((k, [(float(x), float(y)) for x, y in zip(x0 + (x1 - x0) * t, y0 + (y1 - y0) * t)], [float(k % 5) / 2] if k % 2 else [0.0, 3.0]))
    return spark.createDataFrame([*rows, (99, None, [1.0])], "segment_id long, centerline array<struct<x:double,y:double>>, radii array<double>")


def test_segments_are_drawn_in_place(spark, drawn):
    h, w = 50, 80
    points = [tuple(p) for p in raster.centerline_pixels(drawn, h, w).select("segment_id", "y", "x", "radius").distinct().collect()]
    reach = lambda r: range(-int(np.ceil(r)), int(np.ceil(r)) + 1)
    inside = lambda y, x: 0 <= y < h and 0 <= x < w
    disks = {(s, y + dy, x + dx) for s, y, x, r in points for dy in reach(r) for dx in reach(r) if dy * dy + dx * dx <= r * r and inside(y + dy, x + dx)}
    rings = {(s, y + dy, x + dx) for s, y, x, r in points for dy in reach(r + 1) for dx in reach(r + 1) if r * r < dy * dy + dx * dx <= (r + 1) * (r + 1) and inside(y + dy, x + dx)}
    for found, want in ((raster.segment_pixel_map(drawn, h, w), disks), (raster.exchange_pixel_map(drawn, h, w), rings)):
        rows = [tuple(r) for r in found.select("segment_id", "y", "x").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert exchanges(found) == 0
    vessel = {p[1:] for p in disks}
    assert sorted(map(tuple, raster.vessel_mask(drawn, h, w).collect())) == sorted(vessel)
    assert exchanges(raster.vessel_mask(drawn, h, w)) == 1 and exchanges(raster.vessel_boundary(drawn, h, w)) == 1


@pytest.mark.parametrize("tall, wide", [(7, 5), (64, 128)])
def test_tiles_give_what_the_whole_image_has(spark, tall, wide):
    rng = np.random.default_rng(5)
    image = rng.random((40, 33)) < 0.6
    pixels = spark.createDataFrame([(int(y) - 9, int(x) - 11) for y, x in zip(*np.nonzero(image))] * 2, "y int, x int")
    padded = np.pad(image, 1)
    around = sum(padded[i : i + 40, j : j + 33].astype(int) for i in range(3) for j in range(3))
    cells = lambda m: sorted((int(y) - 9, int(x) - 11) for y, x in zip(*np.nonzero(m)))
    for made, want in ((runs.edge_cells, image & (around < 9)), (runs.crowded_cells(3), image & (around >= 4)), (runs.crowded_cells(0), image)):
        assert sorted(map(tuple, runs.painted([runs.of_mask(pixels)], made, 1, tall, wide).collect())) == cells(want)
    joined = runs.union(runs.of_mask(pixels))
    assert sorted(map(tuple, raster.despeckle(joined, 3).collect())) == cells(image & (around >= 4))


def test_a_point_is_one_row_where_pixels_are_looked_for(spark, monkeypatch):
    monkeypatch.setattr(runs, "TALL", 8)
    monkeypatch.setattr(runs, "WIDE", 6)
    rng = np.random.default_rng(1)
    bones = sorted({(int(r), int(c)) for r, c in rng.integers(0, 40, (700, 2))})
    points = [(k, float(r), float(c)) for k, (r, c) in enumerate(rng.random((200, 2)) * 50 - 5)] * 2
    clip = lambda v: int(min(max(np.rint(v), 0), 39))
    want = []
    for k, row, col in points:
        r, c = clip(row), clip(col)
        near = [((y - r) ** 2 + (x - c) ** 2, y, x) for y, x in bones if abs(y - r) <= 3 and abs(x - c) <= 3]
        want.append((k, *min(near)[1:]))
    found = skeleton.nearest_skeleton_pixel(spark.createDataFrame(points, "id int, row double, col double"), spark.createDataFrame(bones, "r int, c int"), 40, 40)
    assert sorted(map(tuple, found.select("id", "sr", "sc").collect())) == sorted(want)
    assert exchanges(found) == 1


def test_thinning_ends_with_the_round_that_settles_all(spark, monkeypatch):
    from perfusia.sources.scratch import Scratch

    kept = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: kept.append(1) or keep(self, df))
    mask = spark.createDataFrame([(y, x) for y in range(3) for x in range(40)], "y int, x int")
    bones = extract.thinned(mask, 16, 8)
    assert len(kept) == 2  # the mask and one round
    assert extract.deletable(bones).count() == 0 and extract.euler(bones.toDF("y", "x")).first()[0] == 1


def test_thinning_keeps_runs(spark, monkeypatch):
    from perfusia.sources.scratch import Scratch

    rows, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: rows.append((kept := keep(self, df)).count()) or kept)
    image = np.zeros((9, 3000), bool)
    image[:7], image[3, 1000:1010] = True, False
    mask = spark.createDataFrame([(y, a, b) for y in range(7) for a, b in ((0, 1500), (1400, 2999)) if y != 3] + [(3, 0, 999), (3, 1010, 2999)], "y int, x0 int, x1 int")
    bones = extract.thinned(mask, 512, 2)
    assert {tuple(r) for r in bones.collect()} == {tuple(p) for p in np.argwhere(extract.thin_layers(image, 0, 0, 100)).tolist()}
    assert max(rows) < 1500  # of 20,990 pixels
    kept = extract.thinned_runs(keep(Scratch(spark, "mask"), mask))
    assert extract.summary(mask, kept).first() == (0, 0, 0)
    assert extract.summary(mask.where("y < 3"), mask).first().outside == 4 * 3000 - 10


@pytest.mark.parametrize("per_span, most", [(16, 1 << 19), (16, 40), (1 << 16, 1 << 19)])
def test_components_are_solved_in_their_span_of_ids(spark, monkeypatch, per_span, most):
    """Chains within spans and across, one too large, one without a fixed node, fixed nodes without links; labels that are given take the other way."""
    rng = np.random.default_rng(6)
    base = 1 << 40
    chains = [list(range(k, k + n)) for k, n in ((0, 5), (5, 3), (8, 1), (9, 14), (23, 40), (63, 6))] + [[69, 200, 70, 201]]
    links = [(a, b) for c in chains for a, b in zip(c, c[1:])] + [(0, 2), (0, 2), (10, 15), (3, 3)]
    nodes = spark.createDataFrame([(base + k, float(k), 0.0) for c in chains for k in c], "node_id long, x double, y double")
    line = [(0.0, 0.0), (1.0, 0.0)]
    rows = [(k, base + a, base + b, line, [float(r)], 1.0, 10.0) for k, ((a, b), r) in enumerate(zip(links, 1 + rng.random(len(links))))]
    segments = spark.createDataFrame(rows, "segment_id long, start_node long, end_node long, centerline array<struct<x:double,y:double>>, radii array<double>, scale double, meta_length_px double")
    fixed = spark.createDataFrame([(base + k, p) for k, p in ((0, 35.0), (4, 15.0), (8, 20.0), (9, 30.0), (22, 10.0), (23, 35.0), (62, 15.0), (69, 40.0), (201, 5.0), (999, 1.0))], "node_id long, pressure double")
    want = flow.solve_network_flow(nodes, segments, fixed, dense=20, labels=flow.component_labels(nodes, segments))
    solved = flow.solved_in_spans
    monkeypatch.setattr(flow, "solved_in_spans", lambda *a: solved(*a, per_span=per_span, most=most))
    got = flow.solve_network_flow(nodes, segments, fixed, dense=20)
    for g, w, key in zip(got, want, ("node_id", "segment_id")):
        g, w = ([tuple(r) for r in x.orderBy(key).collect()] for x in (g, w))
        assert len(g) == len(w) and np.allclose([x[1:] for x in g], [x[1:] for x in w], rtol=1e-9) and [x[0] for x in g] == [x[0] for x in w]


def test_disks_that_stand_together_move_as_few_runs(spark):
    """A line of pixels with a disk each: what is shuffled are the rows of their union, not those of every disk."""
    from perfusia.operators import scaling
    from perfusia.plans import simulate

    h, w = 60, 90
    bones = spark.createDataFrame([(r, c) for c in range(80) for r in (10, 40)], "r int, c int")
    radius = bones.where("c < 70").withColumn("radius", 3.0 + bones.c % 2)
    placed = scaling.banded(scaling.with_distance(bones.union(bones), radius.union(radius.where("c = 5")))).collect()
    assert [(p.r, p.c, p.radius) for p in placed] == [(r, c, 3.0 + c % 2) for r in (10, 40) for c in range(70)]
    segments = spark.createDataFrame([(i, [(float(p.c), float(p.r))], [p.radius]) for i, p in enumerate(placed)], "segment_id long, centerline array<struct<x:double,y:double>>, radii array<double>")
    assert raster.vessel_runs(segments.coalesce(1), h, w).count() < 200  # 1,120 rows of disks
    want = {(r + dy, c + dx) for r, c, q in placed for dy in range(-4, 5) for dx in range(-4, 5) if dy * dy + dx * dx <= q * q and 0 <= c + dx < w}
    got = list(map(tuple, simulate.reconstruct_mask(spark.createDataFrame(placed), h, w).collect()))
    assert len(got) == len(set(got)) and set(got) == want


def test_the_coupled_run_keeps_its_vessels_as_runs(spark, monkeypatch):
    from perfusia.plans import catalogue, simulate

    given = []
    monkeypatch.setattr(simulate, "vessel_coupling", lambda bones, nodes, edges, vessel, *shape: given.append(vessel) or {"sources": vessel})
    catalogue.queries()["r15_coupled_run"](spark, "/root/testdata/sf0.001")
    assert given[0].columns == ["y", "x0", "x1"]
