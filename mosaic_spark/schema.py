"""Column contracts of the engine's tables and plan-time checks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Table name -> required columns with their Spark types.
COUNTS = {"name": "string", "chr": "int", "pos": "long", "n_ref": "int", "n_alt": "int"}
GENOTYPES = {"name": "string", "chr": "int", "pos": "long", "g": "int"}
STATES = {"source": "string", "donor": "string", "name": "string", "chr": "int", "pos": "long", "state": "int"}
SEGMENTS = {"source": "string", "donor": "string", "name": "string", "chr": "int", "start_bp": "long", "end_bp": "long", "state": "int"}
PEDIGREE = {"taxon": "string", "family": "string", "parent1": "string", "parent2": "string", "contribution1": "double", "contribution2": "double", "F": "double"}
MAP = {"locus": "string", "chr": "int", "cm": "double", "bp": "double"}

REF, HET, ALT, MISSING = 0, 1, 2, 3
DEFAULT_SOURCE = "mosaic_spark"


class SchemaError(ValueError):
    """A table lacks columns that an operator needs."""


def require(df: DataFrame, columns, who: str) -> None:
    """Fails while the plan is built; no job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"{who}: needs column(s) {', '.join(missing)}")


def has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def chromosome(label: Column) -> Column:
    """Integer chromosome of a label with or without a leading 'chr'; null where
    the rest is not a number (a plain cast would raise under ANSI rules)."""
    return F.regexp_replace(label.cast("string"), "^chr", "").try_cast("int")


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {v}" for k, v in columns.items())


def with_donor(df: DataFrame, donor: str | None) -> DataFrame:
    """Carries the donor column, or a constant one."""
    return df if "donor" in df.columns else df.withColumn("donor", F.lit(donor).cast("string"))
