"""Diffusion stencils and explicit steps as window expressions over grid rows and columns.

A neighbour that doesn't exist is null, and a null flux counts as none: no-flux borders need no case of
their own. Windows of one partitioning share an exchange and a sort, so a coupled step shuffles twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from perfusia.functions.scalars import michaelis_menten


def along_row() -> WindowSpec:
    return Window.partitionBy("r").orderBy("c")


def along_column() -> WindowSpec:
    return Window.partitionBy("c").orderBy("r")


@dataclass(frozen=True)
class StepParams:
    """reset: vessel cells take their fixed values after each step; mode: see michaelis_menten."""

    dt: float
    dx: float = 1.0
    dy: float = 1.0
    co2_yield: float = 1.0
    reset: bool = True
    mode: str = "clip"

    def stable(self, largest_diffusivity: float) -> bool:
        """Whether the explicit step keeps the maximum principle."""
        return self.dt * largest_diffusivity * (2 / self.dx**2 + 2 / self.dy**2) <= 1


def _face(concentration: str, diffusivity: str, window, spacing: float) -> Column:
    """Flux to the next cell along a window; null at the border."""
    following = lambda x: F.lead(x).over(window)
    return -0.5 * (F.col(diffusivity) + following(diffusivity)) * (following(concentration) - F.col(concentration)) / spacing


def flux(cells: DataFrame, concentration: str, diffusivity: str, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Adds jx and jy, fluxes across a cell's next face along its row and its column."""
    return cells.withColumns({"jx": _face(concentration, diffusivity, along_row(), dx), "jy": _face(concentration, diffusivity, along_column(), dy)})


def flux_divergence(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Adds dc_dt from jx and jy: what comes in less what goes out, none across outer faces."""
    none = F.lit(0.0)
    change = lambda j, w, d: (F.coalesce(F.lag(j).over(w), none) - F.coalesce(F.col(j), none)) / d
    return cells.withColumn("dc_dt", change("jx", along_row(), dx) + change("jy", along_column(), dy))


def diffusion_tendency(cells: DataFrame, concentration: str, diffusivity: str, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    return flux_divergence(flux(cells, concentration, diffusivity, dx, dy), dx, dy).drop("jx", "jy")


def five_point(concentration: str, diffusivity: str, dx: float, dy: float) -> Column:
    """Sum over faces of the face's diffusivity times the difference, fused into one expression."""
    terms = []
    for window, spacing in ((along_row(), dx), (along_column(), dy)):
        for step in (F.lag, F.lead):
            near, d = step(concentration).over(window), step(diffusivity).over(window)
            terms.append(F.coalesce(0.5 * (d + F.col(diffusivity)) * (near - F.col(concentration)), F.lit(0.0)) / (spacing * spacing))
    return terms[0] + terms[1] + terms[2] + terms[3]


def _reset(value: Column, fixed: Column, params: StepParams) -> Column:
    return F.when(F.col("vessel"), fixed).otherwise(value) if params.reset else value


def explicit_step(cells: DataFrame, params: StepParams, concentration: str = "o2", diffusivity: str = "d_o2", vessel_value: str = "vessel_o2") -> DataFrame:
    """One species: diffusion less consumption over dt, then vessels."""
    used = michaelis_menten(F.col(concentration), F.col("vmax"), F.col("km"), F.col("vessel"), params.mode)
    value = F.col(concentration) + params.dt * (five_point(concentration, diffusivity, params.dx, params.dy) - used)
    return cells.withColumn(concentration, _reset(value, F.col(vessel_value), params))


def gas_exchange_step(cells: DataFrame, params: StepParams, vessel_o2: float | None = None, vessel_co2: float | None = None) -> DataFrame:
    """Coupled step: consumption of the oxygen before the step also makes carbon dioxide. Vessel values can be overridden."""
    used = michaelis_menten(F.col("o2"), F.col("vmax"), F.col("km"), F.col("vessel"), params.mode)
    o2 = F.col("o2") + params.dt * (five_point("o2", "d_o2", params.dx, params.dy) - used)
    co2 = F.col("co2") + params.dt * (five_point("co2", "d_co2", params.dx, params.dy) + params.co2_yield * used)
    fixed = lambda given, name: F.col(name) if given is None else F.lit(float(given))
    return cells.withColumns({"o2": _reset(o2, fixed(vessel_o2, "vessel_o2"), params), "co2": _reset(co2, fixed(vessel_co2, "vessel_co2"), params)})
