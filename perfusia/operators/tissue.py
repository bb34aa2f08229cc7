"""Tissue grids: cells (r, c) with concentrations, properties and vessels as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfusia.functions import scalars
from perfusia.functions.species import CARBON_DIOXIDE, OXYGEN, Species

# What a cell has before anything is set.
DEFAULTS = {"o2": 0.0, "co2": 0.0, "epsilon": 1.0, "tau": 1.0, "mu": 1.0, "temperature": 310.15, "vmax": 0.0, "km": 0.0, "vessel_o2": 0.0, "vessel_co2": 0.0}


def dense_grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Every cell of a grid with default values; dx and dy are width / cols and height / rows of the domain."""
    if rows < 1 or cols < 1:
        raise ValueError("a grid has a row and a column at least")
    at = spark.range(rows * cols)
    return with_defaults(at.select((F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c")))


def with_defaults(cells: DataFrame) -> DataFrame:
    """Adds the columns that cells lack."""
    cells = cells.withColumns({k: F.lit(v) for k, v in DEFAULTS.items() if k not in cells.columns})
    return cells if "vessel" in cells.columns else cells.withColumn("vessel", F.lit(False))


def set_uniform_properties(cells: DataFrame, epsilon: float, tau: float, mu: float) -> DataFrame:
    return cells.withColumns({"epsilon": F.lit(epsilon), "tau": F.lit(tau), "mu": F.lit(mu)})


def set_initial_concentration(cells: DataFrame, concentration: float | Column, species: str = "o2") -> DataFrame:
    """Fills all cells, vessels included."""
    return cells.withColumn(species, F.lit(concentration) if isinstance(concentration, (int, float)) else concentration)


def set_vessel_mask(cells: DataFrame, mask: DataFrame, concentration: float) -> DataFrame:
    """mask: cells (r, c). There O2 becomes the vessel's and consumption stops; other cells keep what they had."""
    marked = cells.join(mask.select("r", "c").distinct().withColumn("_in", F.lit(True)), ["r", "c"], "left")
    here = F.col("_in").isNotNull()
    return marked.withColumns({
        "vessel": here,
        "vessel_o2": F.when(here, F.lit(concentration)).otherwise(F.col("vessel_o2")),
        "o2": F.when(here, F.lit(concentration)).otherwise(F.col("o2")),
        "vmax": F.when(here, F.lit(0.0)).otherwise(F.col("vmax")),
    }).drop("_in")


def masked(cells: DataFrame, mask: DataFrame, fields: list[str]) -> DataFrame:
    """(r, c, fields) of the cells in a mask of cells (r, c)."""
    return cells.select("r", "c", *fields).join(mask.select("r", "c"), ["r", "c"], "left_semi")


def set_uniform_consumption(cells: DataFrame, vmax: float, km: float = 0.05) -> DataFrame:
    return cells.withColumns({"vmax": F.when(F.col("vessel"), F.lit(0.0)).otherwise(F.lit(vmax)), "km": F.lit(km)})


def with_diffusivities(cells: DataFrame, oxygen: Species = OXYGEN, carbon_dioxide: Species = CARBON_DIOXIDE) -> DataFrame:
    args = [F.col(x) for x in ("temperature", "mu", "epsilon", "tau")]
    return cells.withColumns({"d_o2": oxygen.effective_diffusivity(*args), "d_co2": carbon_dioxide.effective_diffusivity(*args)})


def oxygen_consumption(cells: DataFrame, mode: str = "clip") -> DataFrame:
    return cells.withColumn("consumption", scalars.michaelis_menten(F.col("o2"), F.col("vmax"), F.col("km"), F.col("vessel"), mode))


def overlay_frame(cells: DataFrame, anoxic: float = 0.2) -> DataFrame:
    """r, c, red, green, blue, alpha of a frame: both gases as colours, anoxic cells dark and opaque, vessels dark red."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    o2, co2 = unit(F.col("o2") / 1.0), unit(F.col("co2") / 0.5)
    lack = unit((F.lit(anoxic) - F.col("o2")) / anoxic)
    dim = 1 - 0.7 * lack
    # Weight of each gas in red, green, blue and alpha.
    weights = {"red": (1.0, 0.0), "green": (0.55, 0.8), "blue": (0.10, 1.0), "alpha": (0.65, 0.55)}
    mixed = {k: unit(o2 * a + co2 * b) for k, (a, b) in weights.items()}
    red, green, blue = (mixed[k] * dim for k in ("red", "green", "blue"))
    alpha = unit(mixed["alpha"] + 0.75 * lack)
    pick = lambda vessel, other: F.when(F.col("vessel"), F.lit(vessel)).otherwise(other)
    return cells.select("r", "c", pick(0.45, red).alias("red"), pick(0.0, green).alias("green"), pick(0.0, blue).alias("blue"), pick(1.0, alpha).alias("alpha"))
