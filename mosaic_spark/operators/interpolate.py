"""Genotypes at new positions, from the observed markers on both sides.

Targets find their flanks among marker positions first (a sorted union and two
windows per chromosome, without samples); genotypes of the flanks then join by
position, so the large table is read with two equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require

MODES = ("continuous", "step", "round", "chen2019")


def flanks(observed: DataFrame, target: DataFrame, coord: str) -> DataFrame:
    """(chr, coord, left, right): nearest observed positions at or below, and above
    (at or above at the chromosome's end); null where there is none."""
    both = observed.select("chr", F.col(coord).alias("x"), F.lit(1).alias("o")).unionByName(target.select("chr", F.col(coord).alias("x"), F.lit(0).alias("o")))
    seen = F.when(F.col("o") == 1, F.col("x"))
    # observed markers come before targets of the same place, so an exact hit is the left flank
    back = Window.partitionBy("chr").orderBy("x", F.col("o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("chr").orderBy("x", F.col("o").desc()).rowsBetween(0, Window.unboundedFollowing)
    rows = both.withColumns({"left": F.last(seen, True).over(back), "right": F.first(seen, True).over(ahead)})
    return rows.where("o = 0").select("chr", F.col("x").alias(coord), "left", "right")


def interpolate_genotype(geno: DataFrame, target: DataFrame, mode: str = "continuous", coord: str = "cm", validate: bool = True) -> DataFrame:
    """(chr, coord, sample, dosage) at every target (chr, coord) and sample.

    geno is long: (chr, coord, sample, dosage), complete and strictly increasing per
    chromosome. continuous: linear between the flanks; step: the nearer flank, the
    right one midway; round: linear, halves away from zero; chen2019: the flanks'
    common value, else null, and null beyond the ends. Other modes hold the end
    value beyond the ends."""
    if mode not in MODES:
        raise ValueError(f"interpolate_genotype: mode must be one of {', '.join(MODES)}")
    require(geno, ("chr", coord, "sample", "dosage"), "interpolate_genotype: geno")
    require(target, ("chr", coord), "interpolate_genotype: target")
    if validate:
        bad = geno.groupBy("chr", coord, "sample").agg(F.count(F.lit(1)).alias("n"), F.count("dosage").alias("k")).agg(F.max("n").alias("n"), F.min(F.col("k") - F.col("n")).alias("k")).first()
        if (bad.k or 0) < 0:
            raise ValueError("interpolate_genotype: `geno` must be complete (no null)")
        if (bad.n or 1) > 1:
            raise ValueError(f"interpolate_genotype: `{coord}` must be strictly increasing within a chromosome (collapse tied positions)")
        if target.join(geno.select("chr").distinct(), "chr", "left_anti").limit(1).count():
            raise ValueError("interpolate_genotype: a target chromosome has no observed markers")
    where = flanks(geno.select("chr", coord).distinct(), target.select("chr", coord), coord)
    side = lambda s: geno.select("chr", F.col(coord).alias(s), "sample", F.col("dosage").cast("double").alias(f"v_{s}"))
    held = where.withColumns({"in_range": F.col("left").isNotNull() & F.col("right").isNotNull(), "left": F.coalesce("left", "right"), "right": F.coalesce("right", "left")})
    rows = held.join(side("left"), ["chr", "left"]).join(side("right"), ["chr", "right", "sample"])
    vl, vr = F.col("v_left"), F.col("v_right")
    w = F.coalesce(F.try_divide(F.col(coord) - F.col("left"), F.col("right") - F.col("left")), F.lit(0.0))
    line = vl + w * (vr - vl)
    value = {
        "continuous": line,
        "step": F.when(w < 0.5, vl).otherwise(vr),
        "round": F.round(line),
        "chen2019": F.when((F.col(coord) == F.col("left")) | (F.col("in_range") & (vl == vr)), vl),
    }[mode]
    return rows.select("chr", coord, "sample", value.alias("dosage"))
