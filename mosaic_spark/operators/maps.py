"""Physical and genetic positions, by a monotone curve per chromosome."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels.spline import MonotoneCurve
from ..schema import require


class PositionMap:
    """``column(chr, x)`` for plans, ``values(chr, x)`` for arrays.

    A genetic map is a few ten thousand loci whatever the cohort's size; its curves
    are built on the driver and go along with the tasks."""

    def __init__(self, table: DataFrame, source: str, target: str) -> None:
        require(table, ("chr", source, target), "map")
        rows = table.select("chr", source, target).collect()
        by: dict[int, list[tuple[float, float]]] = {}
        for r in rows:
            by.setdefault(int(r[0]), []).append((float(r[1]), float(r[2])))
        unsorted = [c for c, v in by.items() if any(a[0] > b[0] for a, b in zip(v, v[1:]))]
        if unsorted:
            warnings.warn(f"map: `{source}` not sorted on chromosome(s) {', '.join(map(str, sorted(unsorted)))}; sorting", stacklevel=3)
        self.curves = {}
        for c, v in by.items():
            try:
                self.curves[c] = MonotoneCurve(*zip(*v))
            except ValueError:
                raise ValueError(f"map: chromosome {c} has < 2 distinct `{source}` values") from None

    def values(self, chrom, x) -> np.ndarray:
        x = np.asarray(x, float)
        chrom, out = np.broadcast_to(np.asarray(chrom), x.shape), np.empty(x.shape)
        for c in np.unique(chrom):
            if int(c) not in self.curves:
                raise KeyError(f"chromosome not in map: {c}")
            out[chrom == c] = self.curves[int(c)](x[chrom == c])
        return out

    def column(self, chrom: Column, x: Column) -> Column:
        values = self.values

        @F.pandas_udf("double")
        def at(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for c, v in batches:
                yield pd.Series(values(c.to_numpy(), v.to_numpy()))

        return at(chrom, x.cast("double"))


def bp_to_cm(table: DataFrame) -> PositionMap:
    return PositionMap(table, "bp", "cm")


def cm_to_bp(table: DataFrame) -> PositionMap:
    return PositionMap(table, "cm", "bp")


def cm_to_mb(segments: DataFrame, table: DataFrame) -> DataFrame:
    """Segments with start_mb and end_mb from start_cm and end_cm."""
    to = cm_to_bp(table)
    return segments.withColumns({f"{e}_mb": to.column(F.col("chr"), F.col(f"{e}_cm")) / 1e6 for e in ("start", "end")})


def build_marker_grid(table: DataFrame, n_markers: int = 2000) -> DataFrame:
    """Evenly spaced markers (chr, pos, cm): each chromosome has its share of the
    physical span, at least 2."""
    require(table, ("chr", "cm", "bp"), "build_marker_grid")
    span = table.groupBy("chr").agg(F.min("bp").alias("lo"), F.max("bp").alias("hi"))
    total = span.agg(F.sum(F.col("hi") - F.col("lo"))).first()[0]
    span = span.withColumn("n", F.greatest(F.lit(2), F.rint(n_markers * (F.col("hi") - F.col("lo")) / total).cast("int")))
    rows = span.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pos = F.rint(F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (F.col("n") - 1)).cast("long")
    rows = rows.select("chr", pos.alias("pos"))
    return rows.withColumn("cm", bp_to_cm(table).column(F.col("chr"), F.col("pos")))
