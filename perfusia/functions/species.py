"""Diffusing species."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Species:
    """free_diffusivity: a number, or a function of the temperature and viscosity Columns."""

    name: str
    molecular_weight: float
    diffusivity: float | Callable[[Column, Column], Column] | None = None

    def free_diffusivity(self, temperature: Column, mu: Column) -> Column:
        if self.diffusivity is None:
            raise NotImplementedError(f"{self.name} has no diffusivity")
        return self.diffusivity(temperature, mu) if callable(self.diffusivity) else F.lit(self.diffusivity)

    def effective_diffusivity(self, temperature: Column, mu: Column, epsilon: Column, tau: Column) -> Column:
        """Free diffusivity times porosity over tortuosity."""
        return self.free_diffusivity(temperature, mu) * epsilon / tau


# Molecular weights in g/mol, diffusivities in m^2/s.
OXYGEN = Species("Oxygen", 32.00, 2.0e-9)
CARBON_DIOXIDE = Species("Carbon Dioxide", 44.01, 1.6e-9)


def species_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.name, s.molecular_weight, s.diffusivity) for s in (OXYGEN, CARBON_DIOXIDE)], "name string, molecular_weight double, free_diffusivity double")
