"""Geometry from masks beside flood fills and plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from perfusia.operators import extract


def pieces(image, eight):
    """The number of connected pieces."""
    left, n = {tuple(p) for p in np.argwhere(image).tolist()}, 0
    near = extract.AROUND if eight else [(0, 1), (1, 0), (0, -1), (-1, 0)]
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            y, x = todo.pop()
            for dy, dx in near:
                if (p := (y + dy, x + dx)) in left:
                    left.remove(p)
                    todo.append(p)
    return n


def shape_of(image):
    """Components, and holes."""
    return pieces(image, True), pieces(~np.pad(image, 1), False) - 1


def blobs(seed, h=40, w=50, n=9):
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[:h, :w]
    image = np.zeros((h, w), bool)
    for y, x, r, hole in zip(rng.integers(4, h - 4, n), rng.integers(4, w - 4, n), rng.integers(2, 9, n), rng.integers(0, 4, n)):
        d = (yy - y) ** 2 + (xx - x) ** 2
        image |= d <= r * r
        if hole == 0:
            image &= d > r * r / 4
    return image


def table(spark, image):
    return spark.createDataFrame([tuple(p) for p in np.argwhere(image).tolist()], "y int, x int")


def array(rows, shape):
    out = np.zeros(shape, bool)
    for r in rows.collect():
        out[r.r, r.c] = True
    return out


@pytest.mark.parametrize("seed", range(12))
def test_layers_keep_components_and_holes(seed):
    image = blobs(seed) if seed % 3 else np.random.default_rng(seed).random((30, 30)) < 0.6
    thin = extract.thin_layers(image, 0, 0, 100)
    assert shape_of(thin) == shape_of(image) and not (thin & ~image).any() and (extract.thin_layers(thin, 0, 0, 100) == thin).all()


@pytest.mark.parametrize(("tile", "layers"), [(16, 1), (13, 3), (256, 8)])
def test_tiles_thin_as_the_whole_image(spark, tile, layers):
    image = blobs(5)
    found = extract.thinned(table(spark, image), tile, layers)
    assert (array(found, image.shape) == extract.thin_layers(image, 0, 0, 100)).all() and found.count() == array(found, image.shape).sum()
    assert extract.deletable(found).count() == 0 and extract.deletable(table(spark, image).toDF("r", "c")).count() > 0
    components, holes = shape_of(image)
    assert extract.euler(table(spark, image)).first().euler == components - holes == extract.euler(found.toDF("y", "x")).first().euler


def test_distances_to_the_background(spark):
    image = blobs(3)
    outside = np.argwhere(~image)
    want = {tuple(p): float(np.sqrt(((outside - p) ** 2).sum(1).min())) for p in np.argwhere(image).tolist()}
    assert {(r.r, r.c): r.radius for r in extract.distance_map(table(spark, image), *image.shape).collect()} == pytest.approx(want)
    empty = spark.createDataFrame([], "y int, x int")
    assert extract.distance_map(empty, 5, 5).count() == extract.thinned(empty).count() == 0 and extract.euler(empty).first().euler == 0


def test_nodes_and_edges_of_known_shapes(spark):
    image = np.zeros((60, 80), bool)
    image[10, 5:30] = True  # a line
    image[30:50, 10] = image[30, 10:41] = image[50, 10:41] = image[30:51, 40] = True  # a ring
    image[40, 55:75] = image[30:41, 65] = True  # three arms
    image[5, 70] = True  # a dot
    found = extract.geometry(table(spark, image), *image.shape)
    nodes, edges = found["nodes"].collect(), found["edges"].collect()
    assert sorted(n.node_type for n in nodes) == [0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0]
    assert len(edges) == 5 and sum(e.start_node == e.end_node for e in edges) == 1
    line = next(e for e in edges if e.points[0].y == 10)
    assert line.length_px == 24.0 and len(line.points) == 25 and line.mean_radius == line.max_radius == 1.0 and {line.points[0].x, line.points[-1].x} == {5.0, 29.0}
    ring = next(e for e in edges if e.start_node == e.end_node)
    assert ring.points[0] == ring.points[-1] and len({(p.x, p.y) for p in ring.points}) == len(ring.points) - 1
    for e in edges:
        assert all(max(abs(p.x - q.x), abs(p.y - q.y)) == 1 for p, q in zip(e.points, e.points[1:]))
    assert {(n.row, n.col) for n in nodes} >= {(10.0, 5.0), (10.0, 29.0), (5.0, 70.0)}


def test_thick_vessels_become_a_network(spark):
    """Disks of radius 4 along a fork: three arms, their radii and lengths."""
    yy, xx = np.mgrid[:60, :90]
    image = np.zeros((60, 90), bool)
    for y0, x0, y1, x1 in ((30, 10, 30, 45), (30, 45, 10, 80), (30, 45, 50, 80)):
        for t in np.linspace(0, 1, 60):
            image |= (yy - y0 - t * (y1 - y0)) ** 2 + (xx - x0 - t * (x1 - x0)) ** 2 <= 16
    found = extract.geometry(table(spark, image), *image.shape)
    edges = found["edges"].where("length_px > 15").collect()
    assert len(edges) == 3 and all(3 < e.mean_radius < 6 and e.min_radius >= 1 and 0 < e.normalized_radius <= 1 for e in edges)
    assert sorted(n.node_type for n in found["nodes"].collect())[-1] >= 3.0
