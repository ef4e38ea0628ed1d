"""Runs of equal state as segments, and what is derived from them. Windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_SOURCE, has, require


def to_segments(states: DataFrame, source: str = DEFAULT_SOURCE) -> DataFrame:
    """Markers or bins with a state -> segments (source, donor, name, chr, start_bp,
    end_bp, state).

    A run breaks where the state, the sample or the chromosome changes. Markers give
    their first and last position, bins their own first start and last end. The
    chain stays in one partition for both windows and the final aggregate."""
    require(states, ("name", "chr", "pos", "state"), "to_segments")
    if "source" not in states.columns:
        states = states.withColumn("source", F.lit(source))
    if "donor" not in states.columns:
        states = states.withColumn("donor", F.lit(None).cast("string"))
    interval = has(states, "start_bp", "end_bp")
    chain = Window.partitionBy("name", "chr").orderBy("pos")
    new = F.coalesce((F.col("state") != F.lag("state").over(chain)).cast("int"), F.lit(1))
    run = F.sum("__new").over(chain.rowsBetween(Window.unboundedPreceding, 0))
    rows = states.withColumn("__new", new).withColumn("__run", run)
    start = F.min_by("start_bp", "pos") if interval else F.min("pos")
    end = F.max_by("end_bp", "pos") if interval else F.max("pos")
    out = rows.groupBy("name", "chr", "__run").agg(
        F.min_by("source", "pos").alias("source"), F.min_by("donor", "pos").alias("donor"),
        start.cast("long").alias("start_bp"), end.cast("long").alias("end_bp"), F.min("state").cast("int").alias("state"),
    )
    return out.select("source", "donor", "name", "chr", "start_bp", "end_bp", "state")


def fill_gaps(states: DataFrame, value: str = "state", missing: int = 3) -> DataFrame:
    """Missing runs between equal known neighbours take their value."""
    chain = Window.partitionBy("name", "chr").orderBy("pos")
    known = F.when(F.col(value) != missing, F.col(value))
    before = F.last(known, True).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, True).over(chain.rowsBetween(0, Window.unboundedFollowing))
    return states.withColumn(value, F.when((F.col(value) == missing) & (before == after), before).otherwise(F.col(value)))


def despeckle(states: DataFrame, min_run: int = 2) -> DataFrame:
    """Donor runs of fewer than ``min_run`` units become REF."""
    chain = Window.partitionBy("name", "chr").orderBy("pos")
    new = F.coalesce((F.col("state") != F.lag("state").over(chain)).cast("int"), F.lit(1))
    rows = states.withColumn("__new", new).withColumn("__run", F.sum("__new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.count(F.lit(1)).over(Window.partitionBy("name", "chr", "__run"))
    rows = rows.withColumn("__len", length)
    return rows.withColumn("state", F.when((F.col("state") > 0) & (F.col("__len") < min_run), 0).otherwise(F.col("state"))).drop("__new", "__run", "__len")


def donor_blocks(states: DataFrame) -> DataFrame:
    """(name, chr, start_bp, end_bp, mb): maximal runs of state > 0. An edge lies
    midway to the next marker, or on the marker at a chromosome's end."""
    require(states, ("name", "chr", "pos", "state"), "donor_blocks")
    chain = Window.partitionBy("name", "chr").orderBy("pos")
    donor = (F.col("state") > 0).cast("int")
    rows = states.select("name", "chr", F.col("pos").cast("long").alias("pos"), donor.alias("d"))
    rows = rows.withColumns({"lo": (F.coalesce(F.lag("pos").over(chain), F.col("pos")) + F.col("pos")) / 2, "hi": (F.coalesce(F.lead("pos").over(chain), F.col("pos")) + F.col("pos")) / 2, "new": F.coalesce((F.col("d") != F.lag("d").over(chain)).cast("int"), F.lit(1))})
    rows = rows.withColumn("run", F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, 0))).where("d = 1")
    out = rows.groupBy("name", "chr", "run").agg(F.min("lo").alias("start_bp"), F.max("hi").alias("end_bp"))
    return out.select("name", "chr", "start_bp", "end_bp", ((F.col("end_bp") - F.col("start_bp")) / 1e6).alias("mb"))


#: Cells of the value range in which running counts are summed up apart.
KS_CELLS = 256


def ks_distance(a: DataFrame, b: DataFrame, value: str = "mb") -> DataFrame:
    """One row (d): the two-sample Kolmogorov-Smirnov distance. Samples shrink to counts
    of distinct values first. Running shares, after the last tie, add up inside cells
    of the value range, which are as many whatever the samples' size, and over cells."""
    both = a.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    values = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    edges = sorted(set(both.approxQuantile("v", [k / KS_CELLS for k in range(1, KS_CELLS)], 0.5 / KS_CELLS)))
    cell = F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda e: e < F.col("v"))) if edges else F.lit(0)
    values = values.withColumn("cell", cell)
    up = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    before, every = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cells = values.groupBy("cell").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))  # KS_CELLS rows at most
    cells = cells.select("cell", *[f(c).over(w).alias(n) for c, n, w, f in (("ca", "a0", before, F.sum), ("cb", "b0", before, F.sum), ("ca", "na", every, F.sum), ("cb", "nb", every, F.sum))])
    rows = values.select("cell", F.sum("a").over(up).alias("a"), F.sum("b").over(up).alias("b")).join(F.broadcast(cells), "cell")
    share = lambda x, x0, n: (F.coalesce(F.col(x0), F.lit(0)) + F.col(x)) / F.col(n)
    return rows.select(F.abs(share("a", "a0", "na") - share("b", "b0", "nb")).alias("g")).agg(F.max("g").alias("d"))


def donor_fraction(states: DataFrame) -> DataFrame:
    """(name, donor): share of donor alleles, (het + 2 alt) / (2 markers)."""
    return states.groupBy("name").agg((F.sum(F.col("state")) / (2 * F.count(F.lit(1)))).alias("donor"))


def sample_summary(states: DataFrame) -> DataFrame:
    """Marker counts and percentages of every state per sample."""
    n = [F.count_if(F.col("state") == k) for k in range(3)]
    total = F.count(F.lit(1))
    cols = [x.alias(f"n_{s}") for x, s in zip(n, ("ref", "het", "alt"))]
    cols += [(100 * x / total).alias(f"pct_{s}") for x, s in zip(n, ("ref", "het", "alt"))]
    return states.groupBy("name").agg(total.alias("markers"), *cols)


def quality_metrics(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cohort metrics, per value of ``by`` columns: percentage of each state, mean and
    population deviation of per-sample HET and ALT rates, and the percentage of
    samples without any donor marker."""
    by = by or []
    per = states.groupBy(*by, "name").agg(*[F.count_if(F.col("state") == k).alias(f"n{k}") for k in range(3)], F.count(F.lit(1)).alias("n"))
    return metrics_of_counts(per, by)


def metrics_of_counts(per: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of per-sample counts n0, n1, n2 of n markers."""
    per = per.withColumns({"het": F.col("n1") / F.col("n"), "alt": F.col("n2") / F.col("n")})
    total = F.sum("n")
    return per.groupBy(*by).agg(
        *[(100 * F.sum(f"n{k}") / total).alias(f"pct_{s}") for k, s in enumerate(("ref", "het", "alt"))],
        F.avg("het").alias("mean_het_rate"), F.avg("alt").alias("mean_donor_rate"), F.stddev_pop("het").alias("sd_het_rate"), F.stddev_pop("alt").alias("sd_donor_rate"),
        (100 * F.count_if((F.col("n1") == 0) & (F.col("n2") == 0)) / F.count(F.lit(1))).alias("pct_samples_without_donor"),
    )


def best_parameters(metrics: DataFrame, criterion: str = "donor_rate") -> DataFrame:
    """The metrics row with the highest donor rate, HET rate, or a balance of donor
    rate against samples without donor."""
    score = {"donor_rate": F.col("mean_donor_rate"), "het_rate": F.col("mean_het_rate"), "balanced": 0.7 * F.col("mean_donor_rate") - 0.3 * F.col("pct_samples_without_donor")}
    if criterion not in score:
        raise ValueError(f"criterion must be one of {', '.join(score)}")
    return metrics.withColumn("score", score[criterion]).orderBy(F.col("score").desc()).limit(1)


def site_statistics(genotypes: DataFrame, by: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """Genotype and allele counts, missing share, minor-allele frequency and
    heterozygote share of every site."""
    require(genotypes, (*by, "g"), "site_statistics")
    n = {f"n{k}": F.count_if(F.col("g") == k) for k in range(3)}
    site = genotypes.groupBy(*by).agg(*[v.alias(k) for k, v in n.items()], F.count(F.lit(1)).alias("n"))
    called = F.col("n0") + F.col("n1") + F.col("n2")
    site = site.withColumns({"ref_count": 2 * F.col("n0") + F.col("n1"), "alt_count": 2 * F.col("n2") + F.col("n1"), "p_missing": 1 - called / F.col("n")})
    minor = F.least("ref_count", "alt_count")
    return site.withColumns({"maf": F.coalesce(F.try_divide(minor, F.col("ref_count") + F.col("alt_count")), F.lit(0.0)), "p_het": F.coalesce(F.try_divide(F.col("n1"), called), F.lit(0.0))})


def segregating_sites(genotypes: DataFrame, max_missing: float = 1.0, ratio: float = 0.25, by: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """Site statistics with ``seg``: does the minor-allele count speak for a
    segregation of ``ratio``? The binomial coefficient cancels between hypotheses, so
    log-likelihoods without it are compared."""
    s = site_statistics(genotypes, by)
    k, n = F.least("ref_count", "alt_count"), F.col("ref_count") + F.col("alt_count")
    at = lambda p: k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    mono, quarter, half = at(0.002), at(0.25), at(0.5)
    if ratio in (0.25, 0.75):
        keep = (quarter > half) & (quarter > mono)
    else:
        keep = half > F.log(F.lit(2.0)) + F.greatest(mono, quarter) + F.log1p(F.exp(-F.abs(mono - quarter)))
    return s.withColumn("seg", (F.least("ref_count", "alt_count") > 0) & (F.col("p_missing") <= max_missing) & keep)


def bin_counts(counts: DataFrame, bin_size: int = 1_000_000) -> DataFrame:
    """Genome bins of every sample: sums of reads, informative markers, first and
    last marker position, and the alternative read share (0 without reads)."""
    require(counts, ("name", "chr", "pos", "n_ref", "n_alt"), "bin_counts")
    depth = F.col("n_ref") + F.col("n_alt")
    keep = [F.first("donor", True).alias("donor")] if "donor" in counts.columns else []
    out = counts.groupBy("name", "chr", F.expr(f"CAST(pos AS BIGINT) div {int(bin_size)}").alias("bin")).agg(
        F.min("pos").alias("start_bp"), F.max("pos").alias("end_bp"), F.sum("n_alt").alias("alt"), F.sum(depth).alias("tot"), F.count_if(depth > 0).alias("ninf"), *keep,
    )
    return out.withColumn("alt_freq", F.when(F.col("tot") > 0, F.col("alt") / F.col("tot")).otherwise(F.lit(0.0)))


def paint_calls(calls: DataFrame, track: str | None = None, samples: list[str] | None = None, palette: dict[str, str] | None = None) -> DataFrame:
    """Rectangles of a chromosome painting: name, chr, track, x0 and x1 in Mb, y0 and
    y1 in [0, 1], label and colour. Drawing them is the client's."""
    require(calls, ("name", "chr", "start_bp", "end_bp", "state"), "paint_calls")
    colours = palette or {"REF": "gold", "HET": "springgreen", "ALT": "purple"}
    if len(colours) != 3:
        raise ValueError("paint_calls: palette needs three named colours")
    if track is not None:
        require(calls, (track,), "paint_calls")
    rows = calls.where(F.col("name").isin(samples)) if samples is not None else calls
    names, fills = list(colours), list(colours.values())
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("state") + 1)
    if track is None:
        rows = rows.withColumns({"__t": F.lit(""), "__k": F.lit(0), "__m": F.lit(1)})
    else:
        levels = rows.select(F.col(track).cast("string").alias("__t")).distinct()
        levels = levels.withColumns({"__k": F.row_number().over(Window.orderBy(F.col("__t").desc())) - 1, "__m": F.count(F.lit(1)).over(Window.partitionBy())})
        rows = rows.withColumn("__t", F.col(track).cast("string")).join(levels, "__t")
    gap = F.when(F.col("__m") > 1, 0.015).otherwise(0.0)
    return rows.select(
        "name", "chr", F.col("__t").alias("track"), (F.col("start_bp") / 1e6).alias("x0"), (F.col("end_bp") / 1e6).alias("x1"),
        (F.col("__k") / F.col("__m") + gap).alias("y0"), ((F.col("__k") + 1) / F.col("__m") - gap).alias("y1"), "state", pick(names).alias("label"), pick(fills).alias("fill"),
    )


def plot_fragment_sizes(calls: DataFrame):
    raise NotImplementedError("plot_fragment_sizes is not yet implemented")
