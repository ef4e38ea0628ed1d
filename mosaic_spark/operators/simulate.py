"""Simulated breeding designs and sequencing, the same on any partitioning: every
unit's generator is seeded by what it is (seed, line, chromosome)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.design import parse_design
from ..kernels import meiosis
from ..schema import require
from .maps import build_marker_grid


def _grid(table: DataFrame, n_markers: int, chromosomes) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[int, float]]:
    """Marker (pos, cm) of each chromosome and its genetic length: n_markers rows."""
    if chromosomes is not None:
        table = table.where(F.col("chr").isin([int(c) for c in np.atleast_1d(chromosomes)]))
    lengths = {int(r[0]): float(r[1]) for r in table.groupBy("chr").agg(F.max("cm")).collect()}
    if not lengths:
        raise ValueError("simulate: no markers left after the `chr` subset")
    by: dict[int, list] = {}
    for r in build_marker_grid(table, n_markers).orderBy("chr", "pos").collect():
        by.setdefault(int(r.chr), []).append((int(r.pos), float(r.cm)))
    return {c: tuple(np.array(x) for x in zip(*v)) for c, v in by.items()}, lengths


def _rng(*parts) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(str(p).encode()) for p in parts])


def simulate_nil(spark: SparkSession, design: str = "BC2S2", n: int = 1, table: DataFrame | None = None, n_markers: int = 2000, chr=None, m: int = 10, p: float = 0.0, seed: int = 1, donor: str = "B", names: list[str] | None = None) -> DataFrame:
    """True states (source, donor, name, chr, pos, cm, state) of ``n`` lines."""
    from ..sources.readers import load_map

    n_bc, n_self = parse_design(design)
    grid, lengths = _grid(table if table is not None else load_map(spark), n_markers, chr)
    if names is not None and len(names) != n:
        raise ValueError("simulate_nil: `names` must have length `n`")
    units = spark.range(n * len(grid), numPartitions=None)
    chroms = sorted(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in b.column(0).to_pylist():
                i, c = u // len(chroms), chroms[u % len(chroms)]
                a, f = meiosis.line(lengths[c], n_bc, n_self, _rng(seed, i, c), m, p)
                pos, cm = grid[c]
                state = (meiosis.alleles_at(a, cm) == 2).astype(np.int32) + (meiosis.alleles_at(f, cm) == 2)
                name = names[i] if names is not None else f"sim{i + 1:04d}"
                k = len(pos)
                yield pa.RecordBatch.from_arrays([pa.array(["sim"] * k), pa.array([donor] * k), pa.array([name] * k), pa.array(np.full(k, c), pa.int32()), pa.array(pos, pa.int64()), pa.array(cm), pa.array(state, pa.int32())], names=["source", "donor", "name", "chr", "pos", "cm", "state"])

    return units.mapInArrow(run, "source string, donor string, name string, chr int, pos long, cm double, state int")


def simulate_family(spark: SparkSession, design: str = "BC2S3", families: int = 10, sibs: int = 10, table: DataFrame | None = None, n_markers: int = 1000, chr=None, m: int = 10, p: float = 0.0, seed: int = 1, donor: str = "B", prefix: str = "fam") -> tuple[DataFrame, DataFrame]:
    """(truth, pedigree): sibs that share all generations but the last selfing. The
    shared ancestors are rows of the pedigree without data."""
    from ..sources.readers import load_map

    if families < 1 or sibs < 1:
        raise ValueError("simulate_family: `families` and `sibs` must be positive integers")
    n_bc, n_self = parse_design(design)
    if n_self < 1:
        raise ValueError(f"simulate_family: `design` needs >= 1 selfing generation (got {design})")
    grid, lengths = _grid(table if table is not None else load_map(spark), n_markers, chr)
    chroms = sorted(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in b.column(0).to_pylist():
                f, c = u // len(chroms) + 1, chroms[u % len(chroms)]
                fam = f"{prefix}{f:02d}"
                parent = meiosis.line(lengths[c], n_bc, n_self - 1, _rng(seed, fam, c), m, p)
                pos, cm = grid[c]
                for s in range(1, sibs + 1):
                    rng = _rng(seed, fam, c, s)
                    haps = [meiosis.gamete(*parent, rng, m, p) for _ in range(2)]
                    state = sum((meiosis.alleles_at(h, cm) == 2).astype(np.int32) for h in haps)
                    k = len(pos)
                    yield pa.RecordBatch.from_arrays([pa.array(["sim"] * k), pa.array([donor] * k), pa.array([f"{fam}_L{s:02d}"] * k), pa.array([fam] * k), pa.array(np.full(k, c), pa.int32()), pa.array(pos, pa.int64()), pa.array(cm), pa.array(state, pa.int32())], names=["source", "donor", "name", "family", "chr", "pos", "cm", "state"])

    truth = spark.range(families * len(chroms)).mapInArrow(run, "source string, donor string, name string, family string, chr int, pos long, cm double, state int")
    rows = []
    for f in range(1, families + 1):
        fam = f"{prefix}{f:02d}"
        shared = [f"{fam}_g{k}" for k in range(n_self)]
        rows += [(t, fam, up, up) for t, up in zip(shared, [None, *shared])]
        rows += [(f"{fam}_L{s:02d}", fam, shared[-1], shared[-1]) for s in range(1, sibs + 1)]
    return truth, spark.createDataFrame(rows, "taxon string, family string, parent1 string, parent2 string")


def _uniform(seed: int, salt: int):
    """A uniform double of a row's identity and a salt."""
    return (F.shiftrightunsigned(F.xxhash64("name", "chr", "pos", F.lit(seed), F.lit(salt)), 11) / F.lit(float(1 << 53))).alias(f"u{salt}")


def poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts at uniforms, by inversion."""
    out, p = np.zeros(len(u), np.int64), np.exp(-mean)
    total, k = p, 0
    while (open_ := u >= total).any() and k < mean + 40 * np.sqrt(mean + 1) + 50:
        out[open_] += 1
        k += 1
        p *= mean / k
        total += p
    return out


def binomial(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Binomial counts at uniforms, by inversion."""
    out = np.zeros(len(u), np.int64)
    term = (1 - p) ** n
    total = term.copy()
    for k in range(int(n.max()) if len(n) else 0):
        open_ = (u >= total) & (out < n)
        if not open_.any():
            break
        out[open_] += 1
        term = term * (n - k) / (k + 1) * p / (1 - p)
        total = total + np.maximum(term, 0)
    return out


def simulate_counts(truth: DataFrame, depth: float = 1.0, error: float = 0.01, p_missing: float = 0.0, seed: int = 1) -> DataFrame:
    """Reads (name, donor, chr, pos, n_ref, n_alt, g) of true states: Poisson depth,
    extra missing markers, alternative reads with sequencing errors; g is the true
    state, or 3 without reads."""
    require(truth, ("name", "chr", "pos", "state"), "simulate_counts")
    rows = truth if "donor" in truth.columns else truth.withColumn("donor", F.lit(None).cast("string"))
    rows = rows.select("name", "donor", "chr", "pos", "state", *[_uniform(seed, s) for s in (1, 2, 3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            state, u1, u2, u3 = (b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6, 7))
            d = np.where(u2 < p_missing, 0, poisson(u1, depth))
            share = np.array([error, 0.5, 1 - error])[state]
            alt = binomial(u3, d, share)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(d - alt, pa.int32()), pa.array(alt, pa.int32()), pa.array(np.where(d > 0, state, 3), pa.int32())], names=["name", "donor", "chr", "pos", "n_ref", "n_alt", "g"])

    return rows.mapInArrow(run, "name string, donor string, chr int, pos long, n_ref int, n_alt int, g int")


def simulate_backcross_panel(spark: SparkSession, lines: int = 100, markers: int = 5000, chromosomes: int = 10, donor_frac: float = 0.25, phet: float = 0.03, miss: float = 0.15, width: float = 0.12, family: str = "SIM", seed: int = 1) -> DataFrame:
    """A full-sib panel for benchmarks (name, family, chr, pos, g, state): donor
    blocks, heterozygous borders and strays, missing calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = (np.arange(markers) + 1) * 100_000
        for b in batches:
            for u in b.column(0).to_pylist():
                i, c = u // chromosomes, u % chromosomes + 1
                rng = _rng(seed, i, c)
                state = np.zeros(markers, np.int32)
                for _ in range(rng.poisson(donor_frac / width)):
                    s = rng.integers(markers)
                    state[s : s + max(2, rng.poisson(markers * width))] = 2
                edge = np.zeros(markers, bool)
                edge[1:] |= (state[1:] == 2) & (state[:-1] == 0)
                edge[:-1] |= (state[:-1] == 2) & (state[1:] == 0)
                state[edge] = 1
                state[(state == 0) & (rng.random(markers) < phet)] = 1
                g = np.where(rng.random(markers) < miss, 3, state)
                yield pa.RecordBatch.from_arrays([pa.array([f"L{i + 1:04d}"] * markers), pa.array([family] * markers), pa.array(np.full(markers, c), pa.int32()), pa.array(pos, pa.int64()), pa.array(g, pa.int32()), pa.array(state)], names=["name", "family", "chr", "pos", "g", "state"])

    return spark.range(lines * chromosomes).mapInArrow(run, "name string, family string, chr int, pos long, g int, state int")
