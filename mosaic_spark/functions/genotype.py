"""Per-site genotype calls from read counts, without a chain model. Columns only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require

EPS = 1e-12


def _clamped(p):
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def call_gt(df: DataFrame, prior="hwe", af: str | None = None, error: float = 0.01, ret: str = "call") -> DataFrame:
    """``df`` (name, chr, pos, n_ref, n_alt) with the most probable genotype.

    prior: "flat"; "hwe" with the marker's alternative frequency from column ``af``
    or estimated from all reads of the marker (0.5 where it has none); or three
    weights. ret: "call" adds g (null at zero depth), "dosage" the same as double,
    "post" adds p0, p1, p2. Ties go to the genotype with fewer donor alleles.

    A marker's reads are summed by a partial aggregate and joined back, so a marker
    with any number of samples is never in one task."""
    require(df, ("chr", "pos", "n_ref", "n_alt"), "call_gt")
    if not 0 < error < 0.5:
        raise ValueError("call_gt: error must be in (0, 0.5)")
    if ret not in ("call", "dosage", "post"):
        raise ValueError("call_gt: ret must be call, dosage or post")
    if isinstance(prior, str) and prior not in ("hwe", "flat"):
        raise ValueError("call_gt: prior must be 'hwe', 'flat' or three weights")
    keep = df.columns
    if not isinstance(prior, str):
        w = [float(x) for x in prior]
        if len(w) != 3 or any(not math.isfinite(x) or x < 0 for x in w) or sum(w) == 0:
            raise ValueError("call_gt: a numeric prior needs 3 finite non-negative weights, not all zero")
        logs = [F.lit(math.log(min(max(x / sum(w), EPS), 1.0))) for x in w]
    elif prior == "flat":
        logs = [F.lit(math.log(1 / 3))] * 3
    else:
        if af is None:
            site = df.groupBy("chr", "pos").agg(F.sum("n_alt").alias("__a"), F.sum(F.col("n_ref") + F.col("n_alt")).alias("__n"))
            df = df.join(site, ["chr", "pos"])
            p = _clamped(F.when(F.col("__n") > 0, F.col("__a") / F.col("__n")).otherwise(F.lit(0.5)))
        else:
            bad = F.col(af).isNull() | (F.col(af) < 0) | (F.col(af) > 1)
            p = _clamped(F.when(bad, F.raise_error(F.lit("call_gt: af must be non-null and in [0, 1]"))).otherwise(F.col(af)))
        logs = [2 * F.log1p(-p), F.lit(math.log(2)) + F.log(p) + F.log1p(-p), 2 * F.log(p)]
    r, a = F.col("n_ref").cast("double"), F.col("n_alt").cast("double")
    bad, ok = math.log(error), math.log1p(-error)
    s0, s1, s2 = r * ok + a * bad + logs[0], (r + a) * math.log(0.5) + logs[1], r * bad + a * ok + logs[2]
    covered = (F.col("n_ref") + F.col("n_alt")) > 0
    if ret == "post":
        df = df.withColumns({"__s0": s0, "__s1": s1, "__s2": s2}).withColumn("__m", F.greatest("__s0", "__s1", "__s2"))
        e = [F.exp(F.col(f"__s{k}") - F.col("__m")) for k in range(3)]
        total = e[0] + e[1] + e[2]
        return df.select(*keep, *[F.when(covered, e[k] / total).alias(f"p{k}") for k in range(3)])
    call = F.when((s0 >= s1) & (s0 >= s2), 0).when(s1 >= s2, 1).otherwise(2)
    return df.select(*[c for c in keep if c != "g"], F.when(covered, call).cast("double" if ret == "dosage" else "int").alias("g"))
