"""Steps that are settled in tiles, and what moves for them."""

from __future__ import annotations

import numpy as np
import pytest

from perfusia.operators import nearest, raster, runs, skeleton, transport


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("tall, wide", [(8, 6), (2048, 512)])
def test_neighbours_of_pixels_take_one_shuffle(spark, monkeypatch, tall, wide):
    monkeypatch.setattr(runs, "TALL", tall)
    monkeypatch.setattr(runs.by_tiles, "__defaults__", (tall, wide))
    rng = np.random.default_rng(2)
    pixels = {(int(r) - 7, int(c) - 5) for r, c in rng.integers(0, 30, (400, 2))}
    graph = skeleton.skeleton_graph(spark.createDataFrame([*pixels, *pixels], "r int, c int"))
    assert exchanges(graph) == 1
    want = [(r, c, r + dr, c + dc, i) for r, c in pixels for i, (dr, dc) in enumerate(skeleton.STEPS) if (r + dr, c + dc) in pixels]
    assert sorted(map(tuple, graph.collect())) == sorted(want)


def test_owners_are_found_in_tiles_and_far_ones_after(spark, monkeypatch):
    monkeypatch.setattr(runs, "TALL", 40)  # tiles of ten rows
    monkeypatch.setattr(runs, "WIDE", 12)
    monkeypatch.setattr(nearest, "REACH", 3)
    rng = np.random.default_rng(4)
    points = [(int(y) - 9, int(x), int(s), int(p)) for y, x, s, p in zip(rng.integers(0, 40, 60), rng.integers(0, 30, 60), rng.integers(0, 20, 60), rng.integers(0, 5, 60))]
    targets = {(int(y) - 9, int(x)) for y, x in rng.integers(0, 60, (300, 2))}
    asked, held = spark.createDataFrame([*targets, *targets], "y int, x int"), spark.createDataFrame(points, "y int, x int, segment_id long, pos int")
    near = lambda y, x: min(((py - y) ** 2 + (px - x) ** 2, s, p) for py, px, s, p in points)
    around = {(r.y, r.x): r.segment_id for r in nearest.nearest_around(runs.of_mask(asked), held, 3).collect()}
    assert around == {t: near(*t)[1] if near(*t)[0] <= 9 else None for t in targets} and None in around.values()
    found = nearest.nearest_points(asked, held).collect()
    assert len(found) == len(targets) and {(r.y, r.x): r.segment_id for r in found} == {t: near(*t)[1] for t in targets}
    assert exchanges(nearest.nearest_around(runs.of_mask(asked), held, 3)) == 1


def test_owners_of_a_boundary_are_kept_as_runs(spark, monkeypatch):
    from perfusia.sources.scratch import Scratch

    rows, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: rows.append((kept := keep(self, df)).count()) or kept)
    line = lambda y, a, b: [(float(x), float(y)) for x in range(a, b)]
    segments = spark.createDataFrame([(7, line(9, 0, 700), [2.0]), (3, line(9, 699, 1300), [2.0]), (5, line(12, 100, 200), [0.0])], "segment_id long, centerline array<struct<x:double,y:double>>, radii array<double>")
    shape = (30, 1400)
    vessel = raster.vessel_runs(segments, *shape)
    found = {(r.y, r.x): r.segment_id for r in raster.reconstructed_boundary_pixel_map(segments, vessel, *shape).collect()}
    assert len(rows) == 1 and rows[0] < 60 < 2500 < len(found)
    want = nearest.nearest_points(raster.boundary_mask(vessel), raster.centerline_spots(segments, *shape), tall=8)
    assert found == {(r.y, r.x): r.segment_id for r in want.collect()}


@pytest.mark.parametrize("stretch", [(1.0, 1.0), (1e4, 1.0), (0.0, 1.0)])
def test_places_by_a_tree_of_a_task(stretch):
    rng = np.random.default_rng(9)
    held, asked = (np.round(rng.random((n, 2)) * 40) * stretch for n in (3000, 700))
    owner = rng.permutation(3000)
    got, d2 = nearest.nearest_of(asked, held, owner, leaf=16)
    for place, o, d in zip(asked, got, d2):
        all_of = ((place - held) ** 2).sum(1)
        assert d == all_of.min() and o == owner[all_of == all_of.min()].min()


def test_values_meet_in_tiles_as_runs(spark, monkeypatch):
    monkeypatch.setattr(runs, "TALL", 20)
    monkeypatch.setattr(runs, "WIDE", 7)
    rng = np.random.default_rng(1)
    rows = {(int(s), int(y) - 2, int(x) - 3, int(x) - 3 + int(n)) for s, y, x, n in zip(rng.integers(0, 9, 40), rng.integers(0, 14, 40), rng.integers(0, 20, 40), rng.integers(0, 9, 40))}
    kept = {}
    for s, y, a, b in sorted(rows):  # runs of a segment are apart
        kept.setdefault((s, y), (s, y, a, b))
    strokes = spark.createDataFrame(list(kept.values()), "segment_id long, y int, x0 int, x1 int")
    pixels = runs.pixels(strokes, ("segment_id", "y"))
    known = spark.createDataFrame([(k, None if k == 2 else k / 3, -float(k)) for k in range(6)], "segment_id long, oxygen double, carbon_dioxide double")
    values = {r.segment_id: (r.oxygen, r.carbon_dioxide) for r in transport.complete_concentrations(pixels, known).collect()}
    assert values == {r.segment_id: (r.oxygen, r.carbon_dioxide) for r in transport.complete_concentrations(strokes, known).collect()} and set(values) > set(range(6))
    inside = [(s, y, x) for s, y, a, b in kept.values() for x in range(a, b + 1) if 0 <= y < 11 and 0 <= x < 18]
    last = {}
    for s, y, x in sorted(inside):
        last[y, x] = values[s]
    sums = {(y, x): [sum(v for v in vs if v is not None) if set(vs) != {None} else None for vs in zip(*[values[s] for s, v, w in inside if (v, w) == (y, x)])] for _, y, x in inside}
    for own in (strokes, pixels):
        assert {(r.y, r.x): (r.oxygen, r.carbon_dioxide) for r in transport.boundary_concentration_maps(11, 18, own, known).collect()} == last
        got = {(r.y, r.x): (r.oxygen, r.carbon_dioxide) for r in transport.boundary_source_maps(11, 18, own, known).collect()}
        assert got.keys() == sums.keys() and all(a is None and b is None or abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], sums[k]))


def test_paths_that_stay_near_are_walked_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(runs, "TALL", 8)
    monkeypatch.setattr(runs, "WIDE", 8)
    rng = np.random.default_rng(3)
    image = rng.random((30, 30)) < 0.45
    pixels = [(int(r), int(c)) for r, c in zip(*np.nonzero(image))]
    some = [pixels[k] for k in rng.integers(0, len(pixels), 120)]
    ends = spark.createDataFrame([(k, *a, *b) for k, (a, b) in enumerate(zip(some[:60], some[60:]))] + [(60, *pixels[0], *pixels[0]), (61, -3, -3, -3, -3)], "edge_id int, sr int, sc int, er int, ec int")
    bones = spark.createDataFrame(pixels, "r int, c int")
    want = {}
    for r in skeleton.trace_far(bones, ends, "drop").orderBy("edge_id", "pos").collect():
        want.setdefault(r.edge_id, []).append((r.r, r.c))
    settled = {r.edge_id: [tuple(p) for p in r.way] for r in skeleton.walked(bones, ends, halo=4).where("settled").collect()}
    assert 0 < len(settled) < 62 and all(way == want.get(k, []) for k, way in settled.items()) and any(settled.values())
    monkeypatch.setattr(skeleton.walked, "__defaults__", (4, 4096))
    assert {r.edge_id: [tuple(p) for p in r.way] for r in skeleton.traced_ways(bones, ends, "drop").collect()} == want
    plan = skeleton.walked(bones, ends)
    assert exchanges(plan) == 1
    with pytest.raises(ValueError):
        skeleton.traced_ways(bones, ends).count()


def test_merged_pieces_amount_to_the_whole(monkeypatch):
    """Links of two parts, each folded to a piece of several strips of packed conductances, and the pieces merged: as if eliminated at once."""
    import numpy as np
    import pandas as pd

    from perfusia.operators import dissect

    monkeypatch.setattr(dissect, "STRIP", 12)
    rng = np.random.default_rng(2)
    links = [(a, b, float(rng.random())) for k in (0, 10) for a in range(k, k + 16) for b in range(a + 1, k + 16) if not (k and b < 16)]
    frame = lambda part, own: pd.DataFrame([(part, a, b, g, 0.0) for a, b, g in own] + [(part, 3 + 15 * part, None, 0.5, 4.0 + part)], columns=["part", "a", "b", "g", "right"])
    parts = [frame(0, [x for x in links if x[1] < 16]), frame(1, [x for x in links if x[1] >= 16])]
    first, second = np.arange(0, 8), np.arange(18, 24)
    pieces = [dissect.Front.of_links(p, inner).piece() for p, inner in zip(parts, (first, second))]
    assert [len(p) for p in pieces] == [8, 10]  # strips, not a row for each pair
    both = pd.concat(pieces).rename(columns={"part": "piece"}).assign(part=0)
    merged = dissect.Front.of_pieces(both, np.arange(8, 14))
    want = dissect.Front.of_links(pd.concat(parts).assign(part=0), np.r_[first, second, 8:14])
    got, whole = (dissect.Front.of_pieces(x.piece().assign(piece=0), np.zeros(0, int)) for x in (merged, want))
    assert got.inside.border.tolist() == [14, 15, 16, 17, 24, 25]
    assert all(np.allclose(getattr(got, c), getattr(whole, c), rtol=1e-12) for c in ("between", "ground", "right"))


def test_flow_reads_lengths_without_drawing_lines(spark):
    """Resistances of a network from tables need no centerlines, but still fail where an end isn't a node."""
    import pytest

    from perfusia.operators import flow, network

    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 30.0)], "node_id long, row double, col double")
    edge = "edge_id long, start_node long, end_node long, length_px double, mean_radius double"
    segments = network.network_from_tables(nodes, spark.createDataFrame([(5, 0, 1, 30.0, 2.0)], edge))[1]
    found = flow.segment_resistances(segments)
    assert "centerline" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 1
    with pytest.raises(Exception, match="end doesn't exist"):
        flow.segment_resistances(network.network_from_tables(nodes, spark.createDataFrame([(5, 0, 9, 30.0, 2.0)], edge))[1]).collect()


def test_small_parts_share_a_group(spark, monkeypatch):
    """A chain in parts of a few nodes: a group of rows is many parts."""
    from perfusia.operators import dissect, flow
    from perfusia.sources.scratch import Scratch

    sizes, whole = [], dissect._together
    monkeypatch.setattr(dissect, "_together", lambda rows, more, pieces: sizes.append((pieces, rows.select("part").distinct().count(), len(whole(rows, more, pieces).applyInPandas(lambda a, b: a[["part"]].head(1), "part long").collect()))) or whole(rows, more, pieces))
    links = spark.range(599).selectExpr("id as a", "id + 1 as b", "1.0D as g")
    ground = spark.createDataFrame([(0, 1.0, 601.0), (599, 1.0, 0.0)], "node long, g double, right double")
    places = spark.range(600).selectExpr("id as node", "id as place")
    found = flow.solve_large(links, ground, places, 8, Scratch(spark, "chain"))
    assert sizes[0] == (False, 128, 4)
    got = {r.node_id: r.pressure for r in found.collect()}
    assert sorted(got) == list(range(600)) and all(abs(got[n] - (600 - n)) < 1e-7 for n in got)
