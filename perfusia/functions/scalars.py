"""Scalar expressions of vessel geometry, flow and kinetics. All take and give Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit conversions, viscosities and scales.
PASCAL_PER_MMHG = 133.322
METRE_PER_MICROMETRE = 1e-6
CUBIC_MICROMETRE_PER_CUBIC_METRE = 1e18
BLOOD_VISCOSITY_PA_S = 3.5e-3
MICROMETRE_PER_PIXEL = 1.0


def require(condition: Column, message: str, value: Column) -> Column:
    """The value where the condition holds; elsewhere the query fails with the message."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def segment_resistance(length_um: Column, radius_um: Column, viscosity: float = BLOOD_VISCOSITY_PA_S) -> Column:
    """Poiseuille resistance 8 mu L / (pi r^4) in Pa s / m^3; lengths, radii and viscosity have to be positive."""
    metres, radius = length_um * METRE_PER_MICROMETRE, radius_um * METRE_PER_MICROMETRE
    value = F.lit(8.0 * viscosity) * metres / (F.lit(math.pi) * F.pow(radius, F.lit(4.0)))
    positive = (length_um > 0) & (radius_um > 0) & F.lit(viscosity > 0)
    return require(positive, "segment length, radius and viscosity have to be positive", value)


def cross_sectional_area(radius: Column) -> Column:
    return require(radius >= 0, "radius can't be negative", F.lit(math.pi) * radius * radius)


def surface_area(radius: Column, length: Column) -> Column:
    return require((radius >= 0) & (length >= 0), "radius and length can't be negative", F.lit(2 * math.pi) * radius * length)


def volume(radius: Column, length: Column) -> Column:
    return cross_sectional_area(radius) * require(length >= 0, "length can't be negative", length)


def pascal(mmhg: Column) -> Column:
    return mmhg * PASCAL_PER_MMHG


def mmhg(pascals: Column) -> Column:
    return pascals / PASCAL_PER_MMHG


def cubic_micrometres(cubic_metres: Column) -> Column:
    return cubic_metres * CUBIC_MICROMETRE_PER_CUBIC_METRE


def retained_fraction(flow: Column, largest: Column, minimum: float) -> Column:
    """minimum + (1 - minimum) |flow| / largest; the minimum where nothing flows."""
    return F.when(largest > 0, F.lit(minimum) + F.lit(1 - minimum) * F.abs(flow) / F.when(largest > 0, largest)).otherwise(F.lit(minimum))


def centerline_length(points: Column) -> Column:
    """Length of an array of (x, y) structs; 0 below two points."""
    steps = F.zip_with(
        F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], F.lit(2.0)) + F.pow(b["y"] - a["y"], F.lit(2.0))),
    )
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, d: s + d))


def mean_of(radii: Column) -> Column:
    return require(F.size(radii) > 0, "no radii", F.aggregate(radii, F.lit(0.0), lambda s, r: s + r) / F.greatest(F.size(radii), F.lit(1)))


def straight_line(x0: Column, y0: Column, x1: Column, y1: Column, length: Column) -> Column:
    """max(round half even(length) + 1, 2) evenly spaced (x, y) points from end to end."""
    n = F.greatest(F.rint(length).cast("int") + 1, F.lit(2))
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct((x0 + (x1 - x0) * i / (n - 1)).alias("x"), (y0 + (y1 - y0) * i / (n - 1)).alias("y")),
    )


def radii_along(radii: Column, points: Column) -> Column:
    """One radius a point: as they are, one for all, or interpolated over the length of the list."""
    n, m = F.size(points), F.size(radii)

    def between(i: Column) -> Column:
        at = i * (m - 1) / F.greatest(n - 1, F.lit(1))
        low = F.floor(at).cast("int")
        a, b = F.element_at(radii, low + 1), F.element_at(radii, F.least(low + 2, m))
        return a + (b - a) * (at - low)

    return F.when(m == n, radii).when(m == 1, F.array_repeat(F.element_at(radii, 1), n)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), between))


def other_node(start: Column, end: Column, node: Column) -> Column:
    return F.when(start == node, end).when(end == node, start).otherwise(F.raise_error(F.lit("node isn't an end of the segment")).cast("long"))


def cell_index(r: Column, c: Column, width: Column | int) -> Column:
    return r * width + c


def michaelis_menten(concentration: Column, vmax: Column, km: Column, vessel: Column | None = None, mode: str = "clip") -> Column:
    """Consumption vmax C / (km + C). clip: C below 0 counts as 0 and vessels use nothing; guarded: 0 unless km + C > 0."""
    c = F.greatest(concentration, F.lit(0.0)) if mode == "clip" else concentration
    rate = F.when(km + c > 0, vmax * c / F.when(km + c > 0, km + c)).otherwise(F.lit(0.0))
    return F.when(vessel, F.lit(0.0)).otherwise(rate) if mode == "clip" and vessel is not None else rate


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))
