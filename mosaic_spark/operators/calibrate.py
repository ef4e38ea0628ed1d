"""Choosing parameters: sweeps against simulated block sizes, and metric grids."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.emissions import genotype_emission
from ..functions.specs import GenotypeEmission, GeometricDuration, transition
from ..schema import require
from .blocks import by_unit, column, unit_bounds
from .callers import CHAIN, call_states, caller_sweep, decode_logs
from .segments import best_parameters, metrics_of_counts

#: Default grids and coverage presets.
RATES = (1e-6, 3e-6, 5e-6, 7e-6, 1e-5, 2e-5, 3e-5, 5e-5)
GRID = {"nir": (0.001, 0.01, 0.1, 0.3, 0.5), "germ": (0.001, 0.01, 0.05), "gert": (0.001, 0.01, 0.05), "p": (0.25, 0.5, 0.75), "r_multiplier": (0.5, 1.0, 2.0)}
COVERAGE = {"low": {"nir": 0.02, "germ": 0.08, "gert": 0.15, "mr": 0.20}, "medium": {"nir": 0.01, "germ": 0.05, "gert": 0.10, "mr": 0.10}, "high": {"nir": 0.005, "germ": 0.02, "gert": 0.05, "mr": 0.05}}


def ks_by(blocks: DataFrame, simulated: DataFrame, by: str, value: str = "mb") -> DataFrame:
    """(by, d): Kolmogorov-Smirnov distance of each group's sizes from simulated ones.
    Both sides shrink to counts of distinct sizes; running shares per group."""
    groups = blocks.select(by).distinct()
    sim = simulated.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("b"))
    sim = groups.withColumn("__k", F.lit(1)).join(sim.withColumn("__k", F.lit(1)), "__k").drop("__k")
    own = blocks.groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("a"))
    both = own.withColumn("b", F.lit(0)).unionByName(sim.withColumn("a", F.lit(0))).groupBy(by, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    up, every = Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    gap = F.abs(F.sum("a").over(up) / F.sum("a").over(every) - F.sum("b").over(up) / F.sum("b").over(every))
    return both.withColumn("g", gap).groupBy(by).agg(F.max("g").alias("d"))


def segment_blocks(segments: DataFrame, by: str) -> DataFrame:
    """(by, mb): donor block sizes of swept segments. Neighbouring donor segments are
    one block; its edges lie midway to the neighbouring segment's marker."""
    chain = Window.partitionBy(by, "name", "chr").orderBy("start_bp")
    donor = (F.col("state") > 0).cast("int")
    rows = segments.withColumns({"d": donor, "start_bp": F.col("start_bp").cast("long"), "end_bp": F.col("end_bp").cast("long")}).withColumns({"lo": (F.coalesce(F.lag("end_bp").over(chain), F.col("start_bp")) + F.col("start_bp")) / 2, "hi": (F.coalesce(F.lead("start_bp").over(chain), F.col("end_bp")) + F.col("end_bp")) / 2})
    rows = rows.withColumn("new", F.coalesce((F.col("d") != F.lag("d").over(chain)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, 0))).where("d = 1")
    return rows.groupBy(by, "name", "chr", "run").agg(((F.max("hi") - F.min("lo")) / 1e6).alias("mb")).select(by, "mb")


def ks_sweep(data: DataFrame, simulated: DataFrame, values=RATES, caller: str = "bbnil", **params) -> DataFrame:
    """(value, d, n_blocks, median_mb, at_grid_edge) of every swept parameter value;
    ``simulated`` has block sizes in a column mb."""
    by = {"bbnil": "rrate", "nnil": "rrate", "rtiger": "rigidity", "lbimpute": "recombdist"}[caller]
    blocks = segment_blocks(caller_sweep(data, caller, values, **params), by)
    stats = blocks.groupBy(by).agg(F.count(F.lit(1)).alias("n_blocks"), F.percentile("mb", 0.5).alias("median_mb"))
    edge = F.col(by).isin([min(values), max(values)])
    return ks_by(blocks, simulated, by).join(stats, by).select(F.col(by).alias("value"), "d", "n_blocks", "median_mb", edge.alias("at_grid_edge"))


def calibrate_r(data: DataFrame, simulated: DataFrame, values=RATES, caller: str = "bbnil", **params) -> DataFrame:
    """The row of ks_sweep with the smallest distance, the smaller value on a tie. An
    optimum at the grid's edge is flagged: donor may be under-called."""
    return ks_sweep(data, simulated, values, caller, **params).orderBy("d", "value").limit(1)


def optimize_parameters(genotypes: DataFrame, grid: dict | None = None, base_r: float = 0.01, mr: float = 0.15, f_1: float = 0.25, f_2: float = 0.05) -> DataFrame:
    """Quality metrics of every combination of genotype-chain parameters. All are
    decoded while a chain is in hand; per-sample state counts leave the kernel."""
    require(genotypes, ("name", "chr", "pos", "g"), "optimize_parameters")
    grid = {**GRID, **(grid or {})}
    names = list(grid)
    combos = [dict(zip(names, v)) for v in itertools.product(*grid.values())]

    def kernel(batch):
        bounds, g = unit_bounds(batch, CHAIN), column(batch, "g")
        sample = unit_bounds(batch, ["name"])
        rows = []
        labels = [batch.column(batch.schema.get_field_index("name"))[int(i)].as_py() for i in sample[:-1]]
        for k, c in enumerate(combos):
            logs = genotype_emission(g, GenotypeEmission(c["germ"], c["gert"], c["p"], mr, c["nir"]))
            state = decode_logs(bounds, logs, transition(GeometricDuration(base_r * c["r_multiplier"]), f_1, f_2), True)
            for name, i, j in zip(labels, sample[:-1], sample[1:]):
                rows.append((k, name, *np.bincount(state[i:j], minlength=3).tolist(), int(j - i)))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), *[pa.int64()] * 4))], names=["combo", "name", "n0", "n1", "n2", "n"])

    per = by_unit(genotypes, ["name"], ["chr", "pos"], ["g"], kernel, "combo int, name string, n0 long, n1 long, n2 long, n long")
    table = genotypes.sparkSession.createDataFrame([(k, *[float(c[n]) for n in names]) for k, c in enumerate(combos)], "combo int, " + ", ".join(f"{n} double" for n in names))
    return metrics_of_counts(per, ["combo"]).join(F.broadcast(table), "combo")  # one row a combination


def select_best_parameters(metrics: DataFrame, criterion: str = "donor_rate") -> DataFrame:
    return best_parameters(metrics, criterion)


def estimate_data_parameters(genotypes: DataFrame, expected_maf: float = 0.0156) -> DataFrame:
    """One row: missing_rate, observed_maf (mean over markers), estimated_nir."""
    g = F.when(F.col("g") != 3, F.col("g"))
    site = genotypes.groupBy("chr", "pos").agg((F.avg(g) * 0.5).alias("maf"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") == 3).alias("m"))
    maf = F.avg("maf")
    return site.agg((F.sum("m") / F.sum("n")).alias("missing_rate"), maf.alias("observed_maf")).withColumn("estimated_nir", F.greatest((F.lit(expected_maf) - F.col("observed_maf")) / expected_maf, F.lit(0.001)))


def recombination_rate(n_markers: int, map_length_cm: float = 1500.0, generations: int = 2) -> float:
    """Mean recombination between neighbouring markers."""
    return generations * map_length_cm / (100 * n_markers)


def invalid_genotypes(genotypes: DataFrame) -> DataFrame:
    """Rows whose genotype is not 0, 1, 2 or 3."""
    return genotypes.where(F.col("g").isNull() | ~F.col("g").isin(0, 1, 2, 3))


def call_introgressions(genotypes: DataFrame, coverage: str = "low", r: float = 0.01, f_1: float = 0.25, f_2: float = 0.05, **params) -> DataFrame:
    """Genotype chains with a coverage preset, as one verb."""
    preset = {**COVERAGE.get(coverage, COVERAGE["low"]), **params}
    return call_states(genotypes, "nnil", f_1=f_1, f_2=f_2, rrate=r, **preset)
