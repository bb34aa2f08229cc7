"""Nearest owners: of pixels by a separable distance transform, of points in the plane by regions of bounded membership."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from perfusia.operators import runs
from perfusia.sources.scratch import Scratch

#: Cells of a band, which a task holds in some arrays; rows of a band at most.
CELLS, TALL = 1 << 20, 4096
#: How far around a tile points are looked for before a distance transform is.
REACH = 8


# ---- pixels ----


def column_pass(y: np.ndarray, x: np.ndarray, rank: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of a band the squared distance to the nearest point in its column and that point's rank, the lower of equals; -1 where a
    column has none. Points may lie above or below the band; a cell has one at most."""
    far = np.int64(1) << 40
    held = np.full((height, width), -1, np.int64)
    within = (y >= 0) & (y < height)
    held[y[within], x[within]] = rank[within]
    rows = np.arange(height)[:, None]
    found = []
    for side in (1, -1):  # from above, then from below
        at = np.where(held >= 0, rows * side, -far)
        out = y < 0 if side == 1 else y >= height
        first = np.full(width, -far)
        owner = np.full(width, -1, np.int64)
        order = np.argsort(y[out] * side, kind="stable")  # the nearest to the band comes last and stays
        first[x[out][order]], owner[x[out][order]] = y[out][order] * side, rank[out][order]
        at = np.maximum.accumulate(at[::side], axis=0)[::side]
        below = at < first
        at = np.where(below, first, at)
        ranks = np.where(below, owner, held[np.clip(at * side, 0, height - 1), np.arange(width)])
        found.append((np.where(at > -far, (rows * side - at) ** 2, np.iinfo(np.int64).max), np.where(at > -far, ranks, -1)))
    (d, r), (e, s) = found
    lower = (e < d) | ((e == d) & (s < r))
    return np.where(lower, e, d), np.where(lower, s, r)


def row_pass(g: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each cell (y, x) the column q with the least ((x - q)^2 + g[y, q], rank[y, q]); -1 where a row has no point.

    The lower envelope of each row's parabolas, all rows of the band at once: of two parabolas the one further right wins from some
    whole column on, which integers tell exactly, ties included.
    """
    height, width = g.shape
    owner, start, top = np.full((height, width + 1), -1, np.int64), np.full((height, width + 1), width, np.int64), np.full(height, -1)
    for q in range(width):
        rows = np.flatnonzero(rank[:, q] >= 0)
        push, begins = rows, np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            live = live[top[rows[live]] >= 0]
            y = rows[live]
            p = owner[y, top[y]]
            n, d = g[y, q] + q * q - g[y, p] - p * p, 2 * (q - p)
            t = np.where(rank[y, q] < rank[y, p], -(-n // d), n // d + 1)
            gone = t <= start[y, top[y]]
            begins[live] = np.where(gone, 0, np.maximum(t, 0))
            top[y[gone]] -= 1
            live = live[gone]
        stay = begins < width
        push, begins = push[stay], begins[stay]
        top[push] += 1
        owner[push, top[push]], start[push, top[push]] = q, begins
    out, at = np.empty((height, width), np.int64), np.zeros(height, np.int64)
    every, last = np.arange(height), top
    for x in range(width):
        while (on := np.flatnonzero((at < last) & (start[every, np.minimum(at + 1, width)] <= x))).size:
            at[on] += 1
        out[:, x] = np.where(last >= 0, owner[every, at], -1)
    return out


class _Owners:
    """The targets of a tile and the points in it and around, of several the least segment; what the targets are nearest to comes as runs."""

    def __init__(self, ty: int, tx: int, tall: int, wide: int, reach: int, halo: int, made: Callable[[np.ndarray], np.ndarray]):
        self.y0, self.x0, self.tall, self.wide, self.reach, self.halo, self.made = ty * tall, tx * wide, tall, wide, reach, halo, made
        self.ends = np.zeros((tall + 2 * halo, wide + 2 * halo + 1), np.int32)
        self.segment = np.zeros((tall + 2 * reach, wide + 2 * reach), np.int64)
        self.held = np.zeros(self.segment.shape, bool)

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kind, y, x0, x1, segment = (c.to_numpy().astype(np.int64) for c in rows.columns[2:])
        y, x0, x1 = y - self.y0, x0 - self.x0, x1 - self.x0
        runs_, points = kind == 0, np.flatnonzero(kind)
        row = y[runs_] + self.halo
        np.add.at(self.ends, (row, np.maximum(x0[runs_] + self.halo, 0)), 1)
        np.add.at(self.ends, (row, np.minimum(x1[runs_] + self.halo + 1, self.ends.shape[1] - 1)), -1)
        first, last = np.maximum(x0[points], -self.reach), np.minimum(x1[points], self.wide + self.reach - 1)
        n = last - first + 1
        of = np.repeat(np.arange(len(n)), n)
        place = (y[points] + self.reach)[of] * self.segment.shape[1] + (first + self.reach - (np.cumsum(n) - n))[of] + np.arange(len(of))
        own = segment[points][of]
        order = np.lexsort((own, place))
        order = order[np.append(True, place[order][1:] != place[order][:-1])[: len(order)]]
        place, own = place[order], own[order]
        held, least = self.held.reshape(-1), self.segment.reshape(-1)
        least[place] = np.where(held[place], np.minimum(least[place], own), own)
        held[place] = True
        return iter(())

    def finished(self) -> Iterator[pa.RecordBatch]:
        held = np.flatnonzero(self.ends.any(1))
        if not len(held):
            return
        rows = slice(max(held[0] - 2 * self.halo, 0), min(held[-1] + 2 * self.halo + 1, len(self.ends)))
        y, x = np.nonzero(self.made(np.cumsum(self.ends[rows, :-1], axis=1) > 0))
        y = y + rows.start
        places = np.flatnonzero(self.held)
        named, rank_of = np.unique(self.segment.reshape(-1)[places], return_inverse=True)
        none = np.int32(len(named))
        rank = np.full(self.segment.shape, none, np.int32)
        rank.reshape(-1)[places] = rank_of
        best, left = np.full(len(y), none, np.int32), np.arange(len(y))
        for ring in _rings(self.reach):
            if not len(left):
                break
            found = best[left]
            for dy, dx in ring:
                np.minimum(found, rank[y[left] + self.reach + dy, x[left] + self.reach + dx], out=found)
            best[left] = found
            left = left[found == none]
        first = np.flatnonzero(np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1) | (best[1:] != best[:-1]))[: len(y)])
        last = np.append(first[1:], len(y))[: len(first)] - 1
        segments = pa.array(np.append(named, 0)[best[first]], mask=best[first] == none)
        yield pa.RecordBatch.from_arrays([*(pa.array((v + o).astype(np.int32)) for v, o in ((y[first], self.y0), (x[first], self.x0), (x[last], self.x0))), segments], ["y", "x0", "x1", "segment_id"])


def _rings(reach: int) -> list[list[tuple[int, int]]]:
    """Steps of up to `reach`, those of one length together, the shortest first."""
    found: dict[int, list[tuple[int, int]]] = {}
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if dy * dy + dx * dx <= reach * reach:
                found.setdefault(dy * dy + dx * dx, []).append((dy, dx))
    return [found[d] for d in sorted(found)]


def nearest_around(targets: DataFrame, points: DataFrame, reach: int = REACH, made: Callable[[np.ndarray], np.ndarray] = lambda m: m, halo: int = 0) -> DataFrame:
    """(y, x, segment_id) of nearest_points, segment_id null where no point lies within `reach`; see runs_around."""
    return runs.pixels(runs_around(targets, points, reach, made, halo), ("y", "segment_id")).select("y", "x", "segment_id")


def runs_around(targets: DataFrame, points: DataFrame, reach: int = REACH, made: Callable[[np.ndarray], np.ndarray] = lambda m: m, halo: int = 0, first: int | None = None) -> DataFrame:
    """Runs (y, x0, x1, segment_id) of target pixels with their nearest segment, null where none lies within `reach`. The targets are the cells for which `made` is true, given an
    image of the runs (y, x0, x1) `targets` with a border of `halo` cells more. Points are pixels (y, x, segment_id) or runs (y, x0, x1, segment_id). One shuffle of runs, a task holds one tile.
    Given `first`, before which no point lies, tiles before it get none."""
    tall, wide = runs.TALL // 4, runs.WIDE
    own = runs.of_mask(points.select("y", *(["x0", "x1"] if "x0" in points.columns else ["x"]), "segment_id"), ("segment_id",))

    def dealt(rows: DataFrame, kind: int, segment: Column, border: int, first: int | None) -> DataFrame:
        over = lambda low, high, size: runs.tiles_of(F.col(low), F.col(high), size, border, first)
        there = rows.select(over("y", "y", tall).alias("ty"), "*").select("ty", over("x0", "x1", wide).alias("tx"), "*")
        return there.select("ty", "tx", F.lit(kind).alias("kind"), "y", "x0", "x1", segment.cast("long").alias("segment_id"))

    rows = dealt(targets, 0, F.lit(0), halo, None).union(dealt(own, 1, F.col("segment_id"), reach, first))
    return runs.streamed(rows, lambda ty, tx: _Owners(ty, tx, tall, wide, reach, halo, made), "y int, x0 int, x1 int, segment_id long")


def nearest_points(targets: DataFrame, points: DataFrame, tall: int | None = None, made: Callable[[np.ndarray], np.ndarray] | None = None, halo: int = 0) -> DataFrame:
    """(y, x, segment_id): for each target pixel the segment of the nearest point (y, x, segment_id, ..), of equals the least segment_id.

    Targets are pixels, or what `made` makes of the image of runs (see runs_around). What finds a point near it finds it in its tile; the rest, or all where
    `tall` is given, goes through the distance transform.
    """
    if tall is not None:
        return far_points(targets, points, tall)
    return runs.pixels(nearest_runs(targets, points, made, halo), ("y", "segment_id")).select("y", "x", "segment_id")


def nearest_runs(targets: DataFrame, points: DataFrame, made: Callable[[np.ndarray], np.ndarray] | None = None, halo: int = 0, first: int | None = None) -> DataFrame:
    """nearest_points as a durable table of runs (y, x0, x1, segment_id) that don't overlap; the points may be runs too. `first` is that of runs_around."""
    seen, scratch = Observation(), Scratch(targets.sparkSession, "around")
    found = runs_around(runs.of_mask(targets), points, REACH, *((made, halo) if made else (lambda m: m, 0)), first)
    found = scratch.keep(found.observe(seen, F.count_if(F.col("segment_id").isNull()).alias("far")))
    if not seen.get["far"]:
        return found
    far = runs.pixels(found.where("segment_id is null"))
    spots = points if "x0" not in points.columns else runs.pixels(points, ("y", "segment_id"))
    spots = spots if "pos" in spots.columns else spots.withColumn("pos", F.lit(0))
    return scratch.keep(found.where("segment_id is not null").union(far_points(far, spots).select("y", F.col("x").alias("x0"), F.col("x").alias("x1"), "segment_id")))


def far_points(targets: DataFrame, points: DataFrame, tall: int | None = None) -> DataFrame:
    """nearest_points by a distance transform.

    A distance transform in two passes, down columns and along rows, that carries owners. Rows are dealt to bands; a band
    gets its own points and, for each column, the nearest ones above and below it, so two shuffles do whatever the distances.
    A task holds a band of up to 2^20 cells and at least one row of the image.
    """
    scratch = Scratch(targets.sparkSession, "nearest")
    best = points.groupBy("y", "x").agg(F.min(F.struct("segment_id", "pos")).alias("o")).select("y", "x", "o.segment_id", "o.pos")
    asked = targets.select("y", "x").distinct()
    seen = [Observation(), Observation()]
    ends = [f(c).alias(f"{n}{c}") for c in ("y", "x") for n, f in (("low", F.min), ("high", F.max))]
    best, asked = (scratch.keep(df.observe(s, *ends)) for df, s in zip((best, asked), seen))
    if any(s.get["lowy"] is None for s in seen):
        return asked.select("y", "x", F.lit(None).cast("bigint").alias("segment_id")).where("false")
    y0, x0 = (min(s.get[f"low{c}"] for s in seen) for c in "yx")
    width = max(s.get["highx"] for s in seen) - x0 + 1
    tall = tall or int(min(TALL, max(1, CELLS // width)))
    last = (max(s.get["highy"] for s in seen) - y0) // tall
    band = F.floor((F.col("y") - y0) / tall).cast("long").alias("band")
    held, asked = best.select(band, "y", "x", "segment_id", "pos"), asked.select(band, "y", "x")
    # what a column has last in one band stands above all bands up to the next in which it has some, and the other way round
    own = held.groupBy("x", "band").agg(F.min(F.struct("y", "segment_id", "pos")).alias("first"), F.max_by(F.struct("y", "segment_id", "pos"), "y").alias("end"))
    column = Window.partitionBy("x").orderBy("band")
    own = own.withColumns({"next": F.coalesce(F.lead("band").over(column), F.lit(last)), "before": F.coalesce(F.lag("band").over(column), F.lit(0))})
    spans = F.array(F.struct((F.col("band") + 1).alias("from"), F.col("next").alias("to"), F.col("end").alias("p")), F.struct(F.col("before").alias("from"), (F.col("band") - 1).alias("to"), F.col("first").alias("p")))
    reach = own.select("x", F.explode(spans).alias("s")).where("s.from <= s.to").select("x", "s.p", F.explode(F.sequence("s.from", "s.to")).alias("band"))
    around = held.unionByName(reach.select("band", "p.y", "x", "p.segment_id", "p.pos")).join(asked.select("band").distinct(), "band", "left_semi")

    def run(key: tuple, wanted: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(near) or not len(wanted):
            return pd.DataFrame({"y": [], "x": [], "segment_id": []})
        top = y0 + key[0] * tall
        order = np.lexsort((near.pos.to_numpy(), near.segment_id.to_numpy()))
        y, x, segment = (near[c].to_numpy(np.int64)[order] for c in ("y", "x", "segment_id"))
        rows, columns = wanted.y.to_numpy(np.int64) - top, wanted.x.to_numpy(np.int64)
        left = min(x.min(), columns.min())  # columns without points or targets on the outside take no part
        columns = columns - left
        g, rank = column_pass(y - top, x - left, np.arange(len(y)), tall, int(max(x.max() - left, columns.max())) + 1)
        used = np.unique(rows)
        q = row_pass(g[used], rank[used])[np.searchsorted(used, rows), columns]
        return pd.DataFrame({"y": wanted.y, "x": wanted.x, "segment_id": segment[rank[rows, q]]})

    return asked.groupBy("band").cogroup(around.groupBy("band")).applyInPandas(run, "y int, x int, segment_id long")


# ---- points in the plane ----


def _regions(points: DataFrame, regions: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each inner node of a balanced tree over a bounded sample splits by cx rather than cy, and where; node i has the children 2 i and 2 i + 1."""
    some = np.array([tuple(r) for r in points.select("cy", "cx").orderBy(F.xxhash64("cy", "cx"), "cy", "cx").limit(sample).collect()], float).reshape(-1, 2)
    return _split(some, regions)


def _split(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """The tree of _regions over points (cy, cx), for a power of two of leaves."""
    wide, cuts, members = np.zeros(leaves, bool), np.zeros(leaves), {1: points}
    for node in range(1, leaves):
        own = members.pop(node)
        by = int(np.argmax(np.ptp(own, axis=0))) if len(own) else 0
        cut = float(np.median(own[:, by])) if len(own) else 0.0
        wide[node], cuts[node] = bool(by), cut
        members[2 * node], members[2 * node + 1] = own[own[:, by] <= cut], own[own[:, by] > cut]
    return wide, cuts


def _leaf(tree: tuple[np.ndarray, np.ndarray], cy: np.ndarray, cx: np.ndarray) -> np.ndarray:
    """The leaf of each place, numbered from the number of leaves on."""
    wide, cuts = tree
    at = np.ones(len(cy), np.int64)
    for _ in range(len(cuts).bit_length() - 1):
        at = 2 * at + (np.where(wide[at], cx, cy) > cuts[at])
    return at


def _in_region(rows: DataFrame, tree: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows (id, cy, cx) with the number of their region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cy, cx = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cy", "cx"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_leaf(tree, cy, cx))], [*batch.schema.names, "region"])

    name = rows.columns[0]
    rows = rows.select(F.col(name).cast("long").alias(name), F.col("cy").cast("double").alias("cy"), F.col("cx").cast("double").alias("cx"))
    return rows.mapInArrow(run, f"{name} long, cy double, cx double, region long")


def _gap(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the boxes (low, high) and (a, b) of places, shapes as they broadcast."""
    return (np.maximum(np.maximum(low - b, a - high), 0.0) ** 2).sum(-1)


def nearest_of(asked: np.ndarray, held: np.ndarray, owner: np.ndarray, leaf: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each place asked (cy, cx) the least owner of the nearest places held, and the squared distance.

    Both are dealt to the leaves of a tree over what is held. Places look in their own leaf first, and then in those whose box is as near as what they found.
    """
    order = np.argsort(owner, kind="stable")  # so that the first of equals has the least owner
    held, owner = held[order], owner[order]
    tree = _split(held, 1 << max(0, len(held) // leaf).bit_length())
    leaves = len(tree[1])
    of = _leaf(tree, *held.T) - leaves
    by = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[by], np.arange(leaves + 1))
    full = np.flatnonzero(starts[1:] > starts[:-1])
    low, high = (np.stack([f(held[by], starts[full]) for f in (np.minimum.reduceat, np.maximum.reduceat)])) if len(full) else np.zeros((2, 0, 2))
    found, best = np.zeros(len(asked), np.int64), np.full(len(asked), np.inf)
    own = _leaf(tree, *asked.T) - leaves
    queue = np.argsort(own, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, own[queue][1:] != own[queue][:-1])), len(queue))
    for a, b in zip(cuts[:-1], cuts[1:]):
        for first in range(a, b, leaf):
            rows = queue[first : min(first + leaf, b)]
            places = asked[rows]
            lo, hi = places.min(0), places.max(0)
            gaps = _gap(low, high, lo, hi)
            near = gaps.argmin()

            def nearest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                y, x = (places[:, k, None] - held[members, k] for k in (0, 1))
                d = y * y + x * x
                at = d.argmin(1)
                return members[at], d[np.arange(len(at)), at]

            some = by[starts[full[near]] : starts[full[near] + 1]]
            _, d = nearest(some)
            reach = full[gaps <= d.max() * (1 + 1e-12)]
            members = np.sort(np.concatenate([by[starts[k] : starts[k + 1]] for k in reach]))
            for part in range(0, len(members), 1 << 15):
                at, d = nearest(members[part : part + (1 << 15)])
                less = d < best[rows]
                best[rows[less]], found[rows[less]] = d[less], at[less]
    return owner[found], best


def _in_blocks(asked: DataFrame, held: DataFrame, task_points: int, task_asked: int, boxes: tuple[np.ndarray, ...] | None = None) -> DataFrame:
    """(lost, owner, d2, cy, cx, region): for each asked point its nearest in each shard of the region it looks at, of equals the one of least owner, with a null region.
    Given the boxes (region, low, high) of all regions also, with a null owner, the others that hold places as near. The tables of counts have a row a region."""
    shards = held.groupBy("region").agg(F.ceil(F.count("*") / task_points).alias("shards"))
    blocks = asked.groupBy("region").agg(F.ceil(F.count("*") / task_asked).alias("blocks"))
    share = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # a region can be without points, so that what is asked there finds nothing
    left = asked.join(F.broadcast(blocks), "region").join(F.broadcast(shards), "region", "left").na.fill(1, ["shards"])
    left = left.select("region", F.explode(upto("shards")).alias("shard"), share("blocks", "lost").alias("block"), "lost", "cy", "cx")
    right = held.join(F.broadcast(shards), "region").join(F.broadcast(blocks), "region").select("region", share("shards", "cy", "cx").alias("shard"), F.explode(upto("blocks")).alias("block"), "owner", "cy", "cx")

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        places, lost = a[["cy", "cx"]].to_numpy(float), a.lost.to_numpy()
        owner, d2 = nearest_of(places, b[["cy", "cx"]].to_numpy(float), b.owner.to_numpy()) if len(a) and len(b) else (np.zeros(len(a), np.int64), np.full(len(a), np.inf))
        none = pd.array([None] * len(a), "Int64")
        out = [pd.DataFrame({"lost": lost, "owner": pd.array(owner, "Int64"), "d2": d2, "cy": places[:, 0], "cx": places[:, 1], "region": none})[np.isfinite(d2)]]
        if boxes is not None and len(a):
            region, low, high = boxes
            near = np.flatnonzero((region != key[0]) & (_gap(low, high, places.min(0), places.max(0)) <= d2.max() * (1 + 1e-12)))
            for k in near:
                at = np.flatnonzero(_gap(low[k], high[k], places, places) <= d2 * (1 + 1e-12))
                out.append(pd.DataFrame({"lost": lost[at], "owner": none[at], "d2": d2[at], "cy": places[at, 0], "cx": places[at, 1], "region": pd.array(np.full(len(at), region[k]), "Int64")}))
        return pd.concat([x for x in out if len(x)] or out)

    keys = ["region", "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "lost long, owner long, d2 double, cy double, cx double, region long")


def nearest_places(asked: DataFrame, held: DataFrame, task_points: int = 1 << 15, task_asked: int = 1 << 15, regions: int = 2048, sample: int = 1 << 15) -> DataFrame:
    """(lost, owner): for each point asked (lost, cy, cx) the owner of the nearest point held (owner, cy, cx), the least owner of equals.

    Places where several points lie are merged. A tree over a bounded sample deals the rest to regions, small ones where many lie and large
    ones where few do; regions of over `task_points` are shared among tasks, and each task has a tree of its own. A point looks in its own region first, then in all
    that hold a place as near as what it found; their extents are exact.
    """
    scratch = Scratch(asked.sparkSession, "places")
    seen = Observation()
    held = scratch.keep(held.groupBy("cy", "cx").agg(F.min("owner").alias("owner")).select("owner", "cy", "cx").observe(seen, F.count(F.lit(1)).alias("n")))
    total = seen.get["n"] or 0
    tree = _regions(held, 1 << max(0, min(regions, 2 * total // task_points, sample // 16).bit_length() - 1), sample)
    held, asked = (scratch.keep(_in_region(df, tree)) for df in (held, asked.select("lost", "cy", "cx")))
    extents = held.groupBy("region").agg(*[f(c) for f in (F.min, F.max) for c in ("cy", "cx")]).collect()  # a row a region: at most `regions`
    extents = np.array([tuple(r) for r in extents], float).reshape(-1, 5)
    boxes = extents[:, 0].astype(np.int64), extents[:, 1:3], extents[:, 3:]
    first = scratch.keep(_in_blocks(asked, held, task_points, task_asked, boxes))
    more = _in_blocks(first.where("owner is null").select("lost", "cy", "cx", "region").distinct(), held, task_points, task_asked)
    found = first.where("owner is not null").select("lost", "d2", "owner").union(more.select("lost", "d2", "owner"))
    return found.groupBy("lost").agg(F.min(F.struct("d2", "owner")).alias("b")).select("lost", "b.owner")
