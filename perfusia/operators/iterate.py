"""Many steps: window plans chained with durable tables, or parts of the grid with halos for long runs.

Bands: a grid row is one record of arrays. Rows within `halo` of a band go to it as well; each band then
takes `halo` steps by itself and keeps its own rows. Exact, since what a border lacks moves in by one row
a step. One shuffle takes `halo` steps instead of two shuffles a step.

Tiles: the same in both directions, for grids of any width. A tile is one record of arrays; before each round it sends its
neighbours, on four sides and at four corners, the strips within `halo` of them. A task holds a tile and its halo, whatever the grid's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfusia.operators.stencil import StepParams, gas_exchange_step
from perfusia.sources.scratch import Scratch

STATE = ("o2", "co2")
STATIC = ("d_o2", "d_co2", "vmax", "km", "vessel", "vessel_o2", "vessel_co2")
LONG_RUN = 12  # steps from which bands and tiles are worth their conversion


def steps_by_windows(cells: DataFrame, params: StepParams, steps: int, every: int = 4) -> DataFrame:
    """Chains window plans; a table cuts the lineage after each `every` steps."""
    scratch = Scratch(cells.sparkSession, "steps")
    for done in range(1, steps + 1):
        cells = gas_exchange_step(cells, params)
        if done % every == 0 and done < steps:
            cells = scratch.keep(cells)
    return cells


def _advance(f: dict[str, np.ndarray], p: StepParams, steps: int) -> None:
    """Steps in place on 2-D arrays; borders inside the grid lose a row of truth a step, which the halo covers."""

    def spread(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.zeros_like(c)
        across = 0.5 * (d[:, 1:] + d[:, :-1]) * (c[:, 1:] - c[:, :-1]) / p.dx**2
        along = 0.5 * (d[1:] + d[:-1]) * (c[1:] - c[:-1]) / p.dy**2
        out[:, :-1] += across
        out[:, 1:] -= across
        out[:-1] += along
        out[1:] -= along
        return out

    for _ in range(steps):
        c = np.maximum(f["o2"], 0) if p.mode == "clip" else f["o2"]
        below = f["km"] + c
        used = np.where(below > 0, f["vmax"] * c / np.where(below > 0, below, 1), 0.0)
        if p.mode == "clip":
            used = np.where(f["vessel"], 0.0, used)
        o2 = f["o2"] + p.dt * (spread(f["o2"], f["d_o2"]) - used)
        co2 = f["co2"] + p.dt * (spread(f["co2"], f["d_co2"]) + p.co2_yield * used)
        if p.reset:
            o2, co2 = np.where(f["vessel"], f["vessel_o2"], o2), np.where(f["vessel"], f["vessel_co2"], co2)
        f["o2"], f["co2"] = o2, co2


def to_rows(cells: DataFrame) -> DataFrame:
    """One record a grid row: r and an array over c of each field. The grid has to be dense."""
    fields = [*STATE, *STATIC]
    gathered = cells.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", *fields))).alias("x"))
    return gathered.select("r", *[F.col(f"x.{f}").alias(f) for f in fields])


def to_cells(rows: DataFrame) -> DataFrame:
    fields = [*STATE, *STATIC]
    return rows.select("r", F.posexplode(F.arrays_zip(*fields)).alias("c", "x")).select("r", "c", *[F.col(f"x.{f}").alias(f) for f in fields])


def _band_steps(params: StepParams, take: int, band: int, names: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r", ignore_index=True)
        own = pdf.r // band == pdf.band
        fields = {f: np.stack(pdf[f].to_numpy()) for f in (*STATE, *STATIC)}
        _advance(fields, params, take)
        for f in STATE:
            pdf[f] = list(fields[f])
        return pdf.loc[own, names]

    return run


def steps_by_bands(cells: DataFrame, params: StepParams, steps: int, band: int = 64, halo: int = 20) -> DataFrame:
    if not 1 <= halo <= band:
        raise ValueError("the halo has a row at least and no more than a band")
    scratch = Scratch(cells.sparkSession, "bands")
    rows = scratch.keep(to_rows(cells))
    names, done = ["r", *STATE, *STATIC], 0
    while done < steps:
        take = min(halo, steps - done)

        kept = rows.select(*names)
        near = F.array_distinct(F.transform(F.array(F.lit(-take), F.lit(0), F.lit(take)), lambda d: F.floor((F.col("r") + d) / band).cast("int")))
        rows = scratch.keep(kept.withColumn("band", F.explode(near)).groupBy("band").applyInPandas(_band_steps(params, take, band, names), kept.schema))
        done += take
    return to_cells(rows)


TILE = "ty int, tx int, r int, c int, h int, w int, " + ", ".join(f"{f} binary" for f in (*STATE, *STATIC))


def _record(ty: int, tx: int, r: int, c: int, fields: dict[str, np.ndarray]) -> dict:
    """A rectangle of the grid with its first cell at (r, c), to or from tile (ty, tx)."""
    h, w = fields["o2"].shape
    return {"ty": ty, "tx": tx, "r": r, "c": c, "h": h, "w": w} | {f: np.ascontiguousarray(a, bool if f == "vessel" else float).tobytes() for f, a in fields.items()}


def _fields(x) -> dict[str, np.ndarray]:
    return {f: np.frombuffer(getattr(x, f), bool if f == "vessel" else float).reshape(x.h, x.w) for f in (*STATE, *STATIC)}


def to_tiles(cells: DataFrame, tile: int) -> DataFrame:
    """One record a tile. The grid has to be dense and start at row and column 0."""

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"])
        shape = int(pdf.r.max() - pdf.r.min()) + 1, int(pdf.c.max() - pdf.c.min()) + 1
        return pd.DataFrame([_record(*key, int(pdf.r.min()), int(pdf.c.min()), {f: pdf[f].to_numpy().reshape(shape) for f in (*STATE, *STATIC)})])

    at = cells.withColumns({"ty": F.floor(F.col("r") / tile).cast("int"), "tx": F.floor(F.col("c") / tile).cast("int")})
    return at.groupBy("ty", "tx").applyInPandas(gather, TILE)


def from_tiles(tiles: DataFrame) -> DataFrame:
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples():
                r, c = np.indices((x.h, x.w))
                yield pd.DataFrame({"r": (r + x.r).ravel().astype("int32"), "c": (c + x.c).ravel().astype("int32"), **{f: a.ravel() for f, a in _fields(x).items()}})

    schema = "r int, c int, " + ", ".join(f"{f} {'boolean' if f == 'vessel' else 'double'}" for f in (*STATE, *STATIC))
    return tiles.mapInPandas(spread, schema)


def _strips(tile: int, take: int):
    """Each tile whole for itself, and what lies within `take` of its neighbours for them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x in pdf.itertuples():
                fields = _fields(x)
                for ty in range(max(x.ty - 1, 0), x.ty + 2):
                    for tx in range(max(x.tx - 1, 0), x.tx + 2):
                        rows = slice(max(ty * tile - take - x.r, 0), max((ty + 1) * tile + take - x.r, 0))
                        columns = slice(max(tx * tile - take - x.c, 0), max((tx + 1) * tile + take - x.c, 0))
                        cut = {f: a[rows, columns] for f, a in fields.items()}
                        if cut["o2"].size:
                            out.append(_record(ty, tx, x.r + rows.start, x.c + columns.start, cut))
            yield pd.DataFrame(out)

    return run


def _tile_steps(params: StepParams, take: int, tile: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[(pdf.r // tile == key[0]) & (pdf.c // tile == key[1])]
        if not len(own):  # beyond the grid
            return pd.DataFrame(columns=pdf.columns).astype(pdf.dtypes)
        r, c = int(pdf.r.min()), int(pdf.c.min())
        shape = int((pdf.r + pdf.h).max()) - r, int((pdf.c + pdf.w).max()) - c
        fields = {f: np.zeros(shape, bool if f == "vessel" else float) for f in (*STATE, *STATIC)}
        for x in pdf.itertuples():
            for f, a in _fields(x).items():
                fields[f][x.r - r : x.r - r + x.h, x.c - c : x.c - c + x.w] = a
        _advance(fields, params, take)
        (x,) = own.itertuples()
        return pd.DataFrame([_record(*key, x.r, x.c, {f: a[x.r - r : x.r - r + x.h, x.c - c : x.c - c + x.w] for f, a in fields.items()})])

    return run


def steps_by_tiles(cells: DataFrame, params: StepParams, steps: int, tile: int = 256, halo: int = 20) -> DataFrame:
    if not 1 <= halo <= tile:
        raise ValueError("the halo has a row at least and no more than a tile")
    scratch = Scratch(cells.sparkSession, "tiles")
    tiles, done = scratch.keep(to_tiles(cells, tile)), 0
    while done < steps:
        take = min(halo, steps - done)
        after = scratch.keep(tiles.mapInPandas(_strips(tile, take), TILE).groupBy("ty", "tx").applyInPandas(_tile_steps(params, take, tile), TILE))
        scratch.drop(tiles)
        tiles, done = after, done + take
    return from_tiles(tiles)


def run_steps(cells: DataFrame, params: StepParams, steps: int, engine: str = "auto") -> DataFrame:
    """steps = 0 gives the cells back. Other columns than r, c, state and statics are dropped."""
    cells = cells.select("r", "c", *STATE, *STATIC)
    if engine not in ("auto", "windows", "bands", "tiles"):
        raise ValueError(f"no engine {engine}")
    if steps == 0:
        return cells
    if engine == "windows" or engine == "auto" and steps < LONG_RUN:
        return steps_by_windows(cells, params, steps)
    return steps_by_bands(cells, params, steps) if engine == "bands" else steps_by_tiles(cells, params, steps)
