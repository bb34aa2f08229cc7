"""Domain decomposition of large networks of conductances.

Unknown nodes are ranked along a space-filling curve. A link has the rank of that end which has fewer links, so that a hub's
belong to its neighbours; a part is a run of ranks. Nodes of which all links lie in one part are inside it, the others are the interface.
A part's task eliminates its inside (a Schur complement) and hands on what it amounts to, a piece: conductances between
interface nodes, packed, and to the ground. Pieces of neighbouring parts are merged, as many as a task can hold the inside of, and what no other piece
touches is eliminated again, until nothing is left or a merged part is too large for a task. Pressures are then
put back level by level, each part by its own task. A level moves pieces, not a row for each pair of a border's nodes.

A network is links (a, b, g, label), a < b, between unknown nodes, and ground (node, g, right, label): g the sum of a node's conductances to
fixed nodes, right the sum of each times its pressure, label a rank. Eliminating makes sums of terms of one sign, so nothing cancels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from perfusia.operators.network import ranked
from perfusia.sources.scratch import Scratch

#: Bits of a coordinate on the curve, and what spreads them to every other bit.
BITS = 31
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def along_curve(nodes: DataFrame) -> DataFrame:
    """(node, place) of nodes (node_id, x, y): places near each other on a Z-shaped curve are near each other in the plane."""
    if not {"x", "y"} <= set(nodes.columns):
        return nodes.select(F.col("node_id").alias("node"), F.lit(0).cast("long").alias("place"))
    at = nodes.select("node_id", *[F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.col(c)).alias(c) for c in ("x", "y")])
    ends = at.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))

    def spread(c: str) -> Column:
        v = F.floor((F.col(c) - F.col(f"{c}0")) / F.when(F.col("span") > 0, F.col("span")).otherwise(1.0) * float(2**BITS - 1)).cast("long")
        for shift, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return at.join(F.broadcast(ends)).select(F.col("node_id").alias("node"), spread("x").bitwiseOR(F.shiftleft(spread("y"), 1)).alias("place"))


@dataclass(frozen=True)
class Inside:
    """The inside of a part: its nodes, the border around it, conductances between both and to the ground."""

    part: int
    nodes: np.ndarray
    border: np.ndarray
    matrix: np.ndarray
    to_border: np.ndarray
    ground: np.ndarray
    right: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Inside:
        """rows (part, a, b, inner, g, right): links of inside nodes a to b, which is inside as well where `inner`, and, with a null b, their ground."""
        linked = rows.b.notna().to_numpy()
        a, g = rows.a.to_numpy(np.int64), rows.g.to_numpy(float)
        b, inner = rows.b.fillna(0).to_numpy(np.int64), linked & rows.inner.to_numpy(bool)
        outer = linked & ~inner
        nodes, border = np.unique(np.concatenate([a, b[inner]])), np.unique(b[outer])
        i, n = np.searchsorted(nodes, a), len(nodes)
        matrix, to_border, ground, right = np.zeros((n, n)), np.zeros((n, len(border))), np.zeros(n), np.zeros(n)
        j = np.searchsorted(nodes, b[inner])
        np.subtract.at(matrix, (i[inner], j), g[inner])
        np.subtract.at(matrix, (j, i[inner]), g[inner])
        np.add.at(to_border, (i[outer], np.searchsorted(border, b[outer])), g[outer])
        np.add.at(ground, i[~linked], g[~linked])
        np.add.at(right, i[~linked], rows.right.to_numpy(float)[~linked])
        matrix[np.arange(n), np.arange(n)] = to_border.sum(1) + ground - matrix.sum(1)
        return cls(int(rows.part.iloc[0]), nodes, border, matrix, to_border, ground, right)

    def solve(self, sides: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.diag(self.matrix))[:, None]
        return np.linalg.solve(self.matrix / scale / scale.T, sides / scale) / scale

    def amounts_to(self) -> pd.DataFrame:
        """Links between border nodes (part, a, b, g), a < b, and ground (part, a, null, g, right) that stand for the inside."""
        k = len(self.border)
        found = self.to_border.T @ self.solve(np.column_stack([self.to_border, self.ground, self.right]))
        i, j = np.nonzero(np.triu(found[:, :k], 1) > 0)
        part = {"part": self.part}
        links = pd.DataFrame(part | {"a": self.border[i], "b": pd.array(self.border[j], "Int64"), "g": found[i, j], "right": 0.0})
        ground = pd.DataFrame(part | {"a": self.border, "b": pd.array([None] * k, "Int64"), "g": found[:, k], "right": found[:, k + 1]})
        return pd.concat([links, ground[(ground.g != 0) | (ground.right != 0)]])

    def pressures(self, border: np.ndarray) -> np.ndarray:
        return self.solve((self.right + self.to_border @ border)[:, None])[:, 0]


def labelled(links: DataFrame, ground: DataFrame, places: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """links (a, b, g) and ground (node, g, right) with their ranks along the curve."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).union(ground.select("node")).groupBy("node").agg(F.count("*").alias("degree"))
    placed = degree.join(places, "node", "left").withColumn("order", F.struct("place", "node"))
    known = scratch.keep(ranked(placed, "order", "label").select("node", "label", F.struct("degree", "node").alias("weight")))
    side = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"), F.col("weight").alias(f"{c}_weight"))
    light = F.when(F.col("a_weight") < F.col("b_weight"), F.col("a_label")).otherwise(F.col("b_label"))
    return scratch.keep(links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "g", light.alias("label"))), scratch.keep(ground.join(known.select("node", "label"), "node"))


#: A piece is what a part amounts to at its border: its nodes, their ground, and the conductances between them as the upper triangle by strips
#: of rows, `first` on; the nodes stand with the first strip.
PIECE = "part long, first int, nodes array<long>, ground array<double>, right array<double>, strip binary"
#: Conductances in a strip, about.
STRIP = 1 << 20
#: Parts of links in a group.
BUNCH = 32


def _triangle(k: int, first: int) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """The row after a strip's last, and where its conductances lie in the block of its rows from column `first` on."""
    last = min(k, first + max(1, STRIP // max(k, 1)))
    return last, np.triu_indices(last - first, 1, k - first)


def _piece(rows: list[tuple]) -> pd.DataFrame:
    """Rows as in PIECE, of the same types if there are none."""
    return pd.DataFrame(rows, columns=["part", "first", "nodes", "ground", "right", "strip"]).astype(dict.fromkeys(("nodes", "ground", "right", "strip"), object))


@dataclass(frozen=True)
class Front:
    """Conductances that meet in one part: of its inside, between inside and border, and on the border (the upper triangle), with their ground."""

    inside: Inside
    between: np.ndarray
    ground: np.ndarray
    right: np.ndarray

    @classmethod
    def _empty(cls, part: int, ids: np.ndarray, inner: np.ndarray) -> tuple[Front, np.ndarray, np.ndarray]:
        """A front without conductances, whether each of ids is inside, and its place there or on the border."""
        within = np.isin(ids, inner)
        n, k = int(within.sum()), int((~within).sum())
        place = np.where(within, np.cumsum(within), np.cumsum(~within)) - 1
        inside = Inside(part, ids[within], ids[~within], np.zeros((n, n)), np.zeros((n, k)), np.zeros(n), np.zeros(n))
        return cls(inside, np.zeros((k, k)), np.zeros(k), np.zeros(k)), within, place

    def _add_ground(self, within: np.ndarray, place: np.ndarray, g: np.ndarray, right: np.ndarray) -> None:
        for own, sums in ((within, (self.inside.ground, self.inside.right)), (~within, (self.ground, self.right))):
            for to, values in zip(sums, (g, right)):
                np.add.at(to, place[own], values[own])

    def _closed(self) -> Front:
        x = self.inside
        x.matrix[np.diag_indices(len(x.nodes))] = x.to_border.sum(1) + x.ground - x.matrix.sum(1)
        return self

    @classmethod
    def of_links(cls, rows: pd.DataFrame, inner: np.ndarray) -> Front:
        """rows (part, a, b, g, right): links and, with a null b, ground. Of their nodes, `inner` are inside."""
        linked = rows.b.notna().to_numpy()
        a, b, g = rows.a.to_numpy(np.int64), rows.b.fillna(0).to_numpy(np.int64)[linked], rows.g.to_numpy(float)
        ids = np.unique(np.concatenate([a, b]))
        out, within, place = cls._empty(int(rows.part.iloc[0]), ids, inner)
        i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
        ground = i[~linked]
        out._add_ground(within[ground], place[ground], g[~linked], rows.right.to_numpy(float)[~linked])
        i, g = i[linked], g[linked]
        both, none = within[i] & within[j], ~within[i] & ~within[j]
        one = ~both & ~none
        x, y = place[i], place[j]
        np.subtract.at(out.inside.matrix, (x[both], y[both]), g[both])
        np.subtract.at(out.inside.matrix, (y[both], x[both]), g[both])
        np.add.at(out.between, (np.minimum(x, y)[none], np.maximum(x, y)[none]), g[none])
        np.add.at(out.inside.to_border, (np.where(within[i], x, y)[one], np.where(within[i], y, x)[one]), g[one])
        return out._closed()

    @classmethod
    def of_pieces(cls, rows: pd.DataFrame, inner: np.ndarray) -> Front:
        """rows (part, piece, first, nodes, ground, right, strip): pieces that are merged."""
        rows = rows.sort_values(["piece", "first"])
        heads = rows[rows["first"] == 0]
        ids = np.unique(np.concatenate(heads.nodes.to_list()))
        out, within, place = cls._empty(int(rows.part.iloc[0]), ids, inner)
        strips = iter(zip(rows["first"], rows.strip))
        for nodes, ground, right in zip(heads.nodes, heads.ground, heads.right):
            at, k, last = np.searchsorted(ids, nodes), len(nodes), 0
            out._add_ground(within[at], place[at], np.asarray(ground), np.asarray(right))
            side, spot = within[at], place[at]
            while last < k:
                first, strip = next(strips)
                last, where = _triangle(k, first)
                block = np.zeros((last - first, k - first))
                block[where] = np.frombuffer(strip)
                p, q = side[first:last], side[first:]
                x, y = spot[first:last], spot[first:]
                inner_block = block[np.ix_(p, q)]
                out.inside.matrix[np.ix_(x[p], y[q])] -= inner_block
                out.inside.matrix[np.ix_(y[q], x[p])] -= inner_block.T
                out.inside.to_border[np.ix_(x[p], y[~q])] += block[np.ix_(p, ~q)]
                out.inside.to_border[np.ix_(y[q], x[~p])] += block[np.ix_(~p, q)].T
                # nodes are in order in pieces and on borders, so this is the upper triangle again
                out.between[np.ix_(x[~p], y[~q])] += block[np.ix_(~p, ~q)]
        return out._closed()

    def piece(self) -> pd.DataFrame:
        """Rows as in PIECE; none if there is no border."""
        x, k = self.inside, len(self.inside.border)
        between, ground, right = self.between, self.ground, self.right
        if len(x.nodes):
            found = x.to_border.T @ x.solve(np.column_stack([x.to_border, x.ground, x.right]))
            between, ground, right = between + found[:, :k], ground + found[:, k], right + found[:, k + 1]
        rows, last = [], 0
        while last < k:
            first = last
            last, where = _triangle(k, first)
            strip = between[first:last, first:][where].tobytes()
            rows.append((x.part, first, *([] if first else a for a in (x.border, ground, right)), strip))
        return _piece(rows)

    def pressures(self, border: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"node_id": self.inside.nodes, "pressure": self.inside.pressures(border) if len(self.inside.nodes) else np.zeros(0)})


@dataclass(frozen=True)
class Level:
    """The rows of parts, links or pieces, and the border (part, node) around each."""

    rows: DataFrame
    border: DataFrame
    pieces: bool


def _together(rows: DataFrame, more: DataFrame, pieces: bool) -> PandasCogroupedOps:
    """Rows of a part with more about it. Of links, a group is BUNCH parts in a row: a part is small work, and a group of its own would cost more than that."""
    key = F.col("part") if pieces else F.floor(F.col("part") / BUNCH)
    return rows.groupBy(key.alias("bunch")).cogroup(more.groupBy(key.alias("bunch")))


def _parts(held: pd.DataFrame, more: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """held part by part, each with its rows of more."""
    held, more = (x.iloc[np.argsort(x.part.to_numpy(), kind="stable")] for x in (held, more))
    parts, first = np.unique(held.part.to_numpy(), return_index=True)
    low, high = (np.searchsorted(more.part.to_numpy(), parts, side) for side in ("left", "right"))
    for a, b, c, d in zip(first, [*first[1:], len(held)], low, high):
        yield held.iloc[a:b], more.iloc[c:d]


def _eliminated(rows: DataFrame, inner: DataFrame, pieces: bool, scratch: Scratch) -> tuple[DataFrame, Level]:
    """The pieces that parts (rows) amount to without their inside (part, node), and the level to put back."""
    blank = _piece([])

    def run(held: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pieces:
            return Front.of_pieces(held, own.node.to_numpy(np.int64)).piece() if len(held) else blank
        made = [Front.of_links(rows, inner.node.to_numpy(np.int64)).piece() for rows, inner in _parts(held, own)]
        return pd.concat([x for x in made if len(x)] or [blank])

    made = scratch.keep(_together(rows, inner, pieces).applyInPandas(run, PIECE))
    return made, Level(rows, made.select("part", F.explode("nodes").alias("node")), pieces)


def first_pieces(links: DataFrame, ground: DataFrame, enough: int, scratch: Scratch) -> tuple[DataFrame, Level] | None:
    """Pieces of the network cut into as many runs of ranks as a power of two, so that halves of halves meet where the curve turns. None if their
    insides hold less than a quarter of all nodes, or one is too large for a task or its border too wide."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), "label", F.lit(True).alias("linked")).union(ground.select("node", "label", F.lit(False)))
    own = F.when(F.col("linked"), F.col("label"))
    ends = scratch.keep(ends.groupBy("node").agg(F.coalesce(F.min(own), F.min("label")).alias("low"), F.coalesce(F.max(own), F.max("label")).alias("high")))
    total = ends.count()
    size = 1 << max(enough, 1).bit_length() - 1
    runs = 1 << max(0, (-(-total // size) - 1).bit_length())
    part = lambda c: F.floor(F.col(c) * runs / total).cast("long")
    inner = scratch.keep(ends.where(part("low") == part("high")).select(part("low").alias("part"), "node"))
    largest, held = inner.groupBy("part").count().agg(F.max("count"), F.sum("count")).first()
    if not held or largest > enough or 4 * held < total:
        return None
    touched = links.select(part("label").alias("part"), F.explode(F.array("a", "b")).alias("node")).distinct().groupBy("part").count()
    if (touched.agg(F.max("count")).first()[0] or 0) > 3 * enough:
        return None
    rows = links.select(part("label").alias("part"), "a", "b", "g", F.lit(0.0).alias("right"))
    rows = rows.union(ground.join(ends.select("node", "low"), "node").select(part("low"), "node", F.lit(None).cast("long"), "g", "right"))
    return _eliminated(scratch.keep(rows), inner, False, scratch)


def merged(pieces: DataFrame, enough: int, front: int, scratch: Scratch) -> tuple[DataFrame, Level] | None:
    """Pieces merged, as many to one as have at most `enough` nodes inside and `front` in all; where no two have, two of up to `front`. None if
    that is too much for a task, or hardly anything would be inside."""
    touch = scratch.keep(pieces.select("part", F.explode("nodes").alias("node")))
    ends = scratch.keep(touch.groupBy("node").agg(F.min("part").alias("low"), F.max("part").alias("high")))
    total = ends.count()
    by = lambda c, k: F.shiftrightunsigned(F.col(c), k)
    if total <= enough:
        shift = 62
    else:
        k = F.explode(F.array(*map(F.lit, range(1, 7)))).alias("k")
        at = touch.join(ends, "node").select("node", "part", "low", "high", k)
        at = at.select("k", F.expr("shiftright(part, k)").alias("own"), "node", F.expr("shiftright(low, k) = shiftright(high, k)").alias("inside")).distinct()
        sizes = at.groupBy("k", "own").agg(F.count("*").alias("n"), F.count_if("inside").alias("inside")).groupBy("k").agg(F.max("n").alias("n"), F.max("inside").alias("most"), F.sum("inside").alias("all")).collect()
        fits = [r.k for r in sizes if r.most <= enough and r.n <= front and 10 * r["all"] >= total]
        fits = fits or [r.k for r in sizes if r.k == 1 and r.n <= front and front > 3 * enough and 10 * r["all"] >= total]
        if not fits:
            return None
        shift = max(fits)
    inner = ends.where(by("low", shift) == by("high", shift)).select(by("low", shift).alias("part"), "node")
    rows = pieces.select(by("part", shift).alias("part"), F.col("part").alias("piece"), "first", "nodes", "ground", "right", "strip")
    return _eliminated(rows, inner, True, scratch)


def unpacked(pieces: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pieces as links (a, b, g) and ground (node, g, right)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        front = Front.of_pieces(rows, np.zeros(0, np.int64))
        border, (i, j) = front.inside.border, np.nonzero(front.between)
        links = pd.DataFrame({"a": border[i], "b": pd.array(border[j], "Int64"), "g": front.between[i, j], "right": 0.0})
        return pd.concat([links, pd.DataFrame({"a": border, "b": pd.array([None] * len(border), "Int64"), "g": front.ground, "right": front.right})])

    rows = scratch.keep(pieces.withColumn("piece", F.col("part")).groupBy("part").applyInPandas(run, "a long, b long, g double, right double"))
    links = rows.where("b is not null").groupBy("a", "b").agg(F.sum("g").alias("g"))
    ground = rows.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("g").alias("g"), F.sum("right").alias("right"))
    return links, ground


def nodes_of(links: DataFrame, ground: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("node")).union(ground.select("node")).distinct()


def dissect(links: DataFrame, ground: DataFrame, places: DataFrame, enough: int, scratch: Scratch, front: int = 0) -> tuple[DataFrame, DataFrame, list[Level]]:
    """The network with levels eliminated until nothing is left or a level would gain too little, and the levels. `front`: nodes of a merged part that
    a task may hold, three times `enough` at least."""
    enough = max(enough, 1)
    labels = labelled(links, ground, places, scratch)
    found = first_pieces(*labels, enough, scratch)
    if found is None:
        return links, ground, []
    levels: list[Level] = []
    while found is not None:
        pieces, level = found
        levels.append(level)
        if not pieces.limit(1).count():
            return links.limit(0), ground.limit(0), levels
        found = merged(pieces, enough, max(front, 3 * enough), scratch)
    return *unpacked(pieces, scratch), levels


def solved(links: DataFrame, ground: DataFrame) -> DataFrame:
    """(node_id, pressure) of a network that one task can hold."""
    rows = links.select("a", "b", "g", F.lit(0.0).alias("right")).union(ground.select("node", F.lit(None).cast("long"), "g", "right")).withColumn("part", F.lit(0))

    def run(held: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([held.a.to_numpy(np.int64), held.b.dropna().to_numpy(np.int64)])
        return Front.of_links(held, ids).pressures(np.zeros(0))

    return rows.groupBy("part").applyInPandas(run, "node_id long, pressure double")


def _inside_pressures(pieces: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a part's rows and the pressures (node, pressure) of its border those of its inside."""

    def one(held: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate(held.nodes.to_list()).astype(np.int64) if pieces else np.concatenate([held.a.to_numpy(np.int64), held.b.dropna().to_numpy(np.int64)])
        border = known.node.to_numpy(np.int64)
        by = np.argsort(border)
        front = (Front.of_pieces if pieces else Front.of_links)(held, np.setdiff1d(ids, border))
        return front.pressures(known.pressure.to_numpy(float)[by][np.searchsorted(border[by], front.inside.border)])

    def run(held: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return pd.DataFrame({"node_id": [], "pressure": []})
        return one(held, known) if pieces else pd.concat([one(rows, own) for rows, own in _parts(held, known)])

    return run


def put_back(pressures: DataFrame, levels: list[Level], scratch: Scratch) -> DataFrame:
    """(node_id, pressure) with the nodes of all levels, the last eliminated first. A level reads the pressures of levels after it only where its borders lie."""
    parts = [scratch.keep(pressures)]
    for level in reversed(levels):
        known = parts[0]
        for more in parts[1:]:
            known = known.union(more)
        known = level.border.join(known.select(F.col("node_id").alias("node"), "pressure"), "node")
        parts.append(scratch.keep(_together(level.rows, known, level.pieces).applyInPandas(_inside_pressures(level.pieces), "node_id long, pressure double")))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out
