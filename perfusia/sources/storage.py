"""Reading and writing geometry, cases and arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_FIELDS = ("oxygen_concentration", "carbon_dioxide_concentration", "diffusivity", "vmax", "km", "vessel_mask", "vessel_oxygen_concentration", "vessel_carbon_dioxide_concentration")
CASE = "case_id long, width int, height int, dx double, dy double, dt double, co2_yield double, " + ", ".join(f"{f} array<{'boolean' if f == 'vessel_mask' else 'double'}>" for f in CASE_FIELDS)


def save_geometry(tables: dict[str, DataFrame], folder: str) -> None:
    """A Parquet table for each part: masks, skeleton, distances, nodes, edges, as they are and scaled."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_geometry(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def save_mask(mask: DataFrame, folder: str, band: int) -> None:
    """A mask (y, x) in folders of `band` rows each, so that a window of it opens only those it meets."""
    banded = mask.select("y", "x", F.floor(F.col("y") / band).cast("int").alias("band"))
    banded.repartition("band").write.mode("overwrite").partitionBy("band").parquet(folder)


def read_mask(spark: SparkSession, folder: str, band: int, first: int, end: int) -> DataFrame:
    """(y, x) of the rows from `first` to before `end`."""
    stored = spark.read.schema("y int, x int, band int").parquet(folder)
    return stored.where((F.col("band") >= first // band) & (F.col("band") <= (end - 1) // band) & (F.col("y") >= first) & (F.col("y") < end)).select("y", "x")


def read_case(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON cases of flat row-major arrays as cells; case_id is null where a case has none."""
    case = spark.read.schema(CASE).option("multiLine", multi_line).json(path)
    at = case.select("case_id", "width", "dx", "dy", "dt", "co2_yield", F.posexplode(F.arrays_zip(*CASE_FIELDS)).alias("i", "x"))
    return at.select(
        "case_id", (F.col("i") / F.col("width")).cast("int").alias("r"), (F.col("i") % F.col("width")).alias("c"), "dx", "dy", "dt", "co2_yield",
        F.col("x.oxygen_concentration").alias("o2"), F.col("x.carbon_dioxide_concentration").alias("co2"), F.col("x.diffusivity").alias("d_o2"), F.col("x.diffusivity").alias("d_co2"),
        F.col("x.vmax").alias("vmax"), F.col("x.km").alias("km"), F.col("x.vessel_mask").alias("vessel"),
        F.col("x.vessel_oxygen_concentration").alias("vessel_o2"), F.col("x.vessel_carbon_dioxide_concentration").alias("vessel_co2"),
    )


def write_cases(cells: DataFrame, path: str, dt: float, dx: float = 1.0, dy: float = 1.0, co2_yield: float = 1.0) -> None:
    """A JSON record for each case_id, a small grid by its format; cells without the column are one case."""
    names = dict(zip(CASE_FIELDS, ("o2", "co2", "d_o2", "vmax", "km", "vessel", "vessel_o2", "vessel_co2")))
    keys = ["case_id"] if "case_id" in cells.columns else []
    rows = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("r", "c", *names.values()))).alias("x"), (F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"))
    extra = {"dx": dx, "dy": dy, "dt": dt, "co2_yield": co2_yield}
    rows.select(*keys, "width", "height", *[F.lit(v).alias(k) for k, v in extra.items()], *[F.col(f"x.{v}").alias(k) for k, v in names.items()]).write.mode("overwrite").json(path)


def cells_from_arrays(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """2-D arrays of one shape as cells."""
    shapes = {a.shape for a in arrays.values()}
    if len(shapes) != 1 or len(next(iter(shapes))) != 2:
        raise ValueError(f"arrays of one 2-D shape are needed, not {sorted(shapes)}")
    import pandas as pd

    r, c = np.indices(next(iter(shapes)))
    return spark.createDataFrame(pd.DataFrame({"r": r.ravel().astype("int32"), "c": c.ravel().astype("int32"), **{k: a.ravel() for k, a in arrays.items()}}))


def arrays_from_cells(cells: DataFrame, fields: list[str], most: int = 20_000_000) -> dict[str, np.ndarray]:
    """Back to 2-D arrays on the driver; an error for grids of more than `most` cells."""
    if (n := cells.count()) > most:
        raise ValueError(f"{n} cells are too many for the driver, {most} are allowed")
    pdf = cells.select("r", "c", *fields).toPandas().sort_values(["r", "c"])
    shape = int(pdf.r.max()) + 1, int(pdf.c.max()) + 1
    return {f: pdf[f].to_numpy().reshape(shape) for f in fields}


def masks_from_images(spark: SparkSession, folder: str, predict) -> DataFrame:
    """(path, y, x) of the cells set in each image of a folder. predict: bytes to a 2-D array, the caller's segmentation model."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                y, x = np.nonzero(predict(content))
                yield pd.DataFrame({"path": path, "y": y.astype("int32"), "x": x.astype("int32")})

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, "path string, y int, x int")
