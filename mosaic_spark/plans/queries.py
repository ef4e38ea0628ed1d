"""The engine's queries on the driver's tables: one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import design as designs
from ..functions.emissions import hard_call
from ..functions.genotype import call_gt
from ..operators import calibrate, callers, interpolate, maps, segments, simulate, thinning
from ..sources import readers, writers
from . import files
from .views import bin_genotypes, calls, obs, panel

DESIGN = "BC2S3"
Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callers.call_ancestry(obs(spark, sf_dir), "bbnil", design=DESIGN)


_found["obs_view"] = obs


@query
def min_reads_filter(spark, d):
    return obs(spark, d).where("n_ref + n_alt >= 3")


@query
def site_statistics(spark, d):
    s = segments.site_statistics(calls(spark, d))
    return s.select("chr", "pos", "n0", "n1", "n2", "n", "ref_count", "alt_count", "p_missing", "maf", "p_het")


@query
def segregating_sites(spark, d):
    return segments.segregating_sites(calls(spark, d), 1.0, 0.25).select("chr", "pos", "seg")


@query
def genotype_flat(spark, d):
    return call_gt(obs(spark, d), "flat", ret="dosage")


@query
def genotype_hwe(spark, d):
    return call_gt(obs(spark, d), "hwe", ret="dosage")


@query
def genotype_prior(spark, d):
    return call_gt(obs(spark, d), (0.85, 0.05, 0.10), ret="dosage")


@query
def genotype_posterior(spark, d):
    post = call_gt(obs(spark, d), "flat", ret="post")
    return post.select("name", "chr", "pos", *[F.round(f"p{k}", 6).alias(f"p{k}") for k in range(3)])


@query
def googa_hard_call(spark, d):
    return obs(spark, d).withColumn("g", hard_call(F.col("n_alt"), F.col("n_ref") + F.col("n_alt"), 0.95, 0.25, 2))


@query
def bin_alt_freq(spark, d):
    return segments.bin_counts(obs(spark, d), 500_000).where("ninf >= 1")


def _states(df: DataFrame) -> DataFrame:
    return df.select("name", "chr", "pos", "state")


@query
def viterbi_bbnil(spark, d):
    return _states(callers.call_states(obs(spark, d), "bbnil", design=DESIGN))


@query
def viterbi_nnil(spark, d):
    return _states(callers.call_states(calls(spark, d), "nnil", design=DESIGN))


@query
def viterbi_googa(spark, d):
    return _states(callers.call_states(obs(spark, d), "googa", design=DESIGN, atlas_min_reads=2))


@query
def viterbi_lbimpute(spark, d):
    return _states(callers.call_states(obs(spark, d), "lbimpute", recombdist=1e6))


@query
def rigid_catiger(spark, d):
    return _states(callers.call_states(calls(spark, d), "catiger", design=DESIGN, rigidity=2))


@query
def rigid_atlas(spark, d):
    return _states(callers.call_states(obs(spark, d), "atlas", design=DESIGN, rigidity=2, atlas_min_reads=2))


@query
def segments_bbnil(spark, d):
    return callers.call_ancestry(obs(spark, d), "bbnil", design=DESIGN).select("name", "chr", "start_bp", "end_bp", "state")


@query
def segments_calls(spark, d):
    return segments.to_segments(calls(spark, d).withColumnRenamed("g", "state")).select("name", "chr", "start_bp", "end_bp", "state")


@query
def sweep_bbnil(spark, d):
    return callers.caller_sweep(obs(spark, d), "bbnil", [0.001, 0.01], design=DESIGN).select("name", "chr", "start_bp", "end_bp", "state", "rrate")


@query
def sweep_lbimpute(spark, d):
    return callers.caller_sweep(obs(spark, d), "lbimpute", [2e5, 1e6]).select("name", "chr", "start_bp", "end_bp", "state", "recombdist")


@query
def sweep_nnil(spark, d):
    return callers.caller_sweep(calls(spark, d).drop("n_ref", "n_alt"), "nnil", [0.001, 0.05], design=DESIGN).select("name", "chr", "start_bp", "end_bp", "state", "rrate")


@query
def gap_fill(spark, d):
    return _states(segments.fill_gaps(calls(spark, d).withColumnRenamed("g", "state")))


@query
def despeckle(spark, d):
    return _states(segments.despeckle(calls(spark, d).where("g <> 3").withColumnRenamed("g", "state"), 2))


@query
def donor_blocks(spark, d):
    return segments.donor_blocks(calls(spark, d).where("g <> 3").withColumnRenamed("g", "state"))


@query
def ks_distance(spark, d):
    blocks = segments.donor_blocks(calls(spark, d).where("g <> 3").withColumnRenamed("g", "state"))
    return segments.ks_distance(blocks.where("chr <= 3"), blocks.where("chr > 3")).select(F.round("d", 9).alias("d"))


@query
def donor_fraction(spark, d):
    return segments.donor_fraction(calls(spark, d).where("g <> 3").withColumnRenamed("g", "state"))


@query
def sample_summary(spark, d):
    return segments.sample_summary(calls(spark, d).where("g <> 3").withColumnRenamed("g", "state"))


@query
def quality_metrics(spark, d):
    m = segments.quality_metrics(calls(spark, d).where("g <> 3").withColumnRenamed("g", "state"), ["chr"])
    return m.select("chr", *[F.round(c, 8).alias(c) for c in m.columns if c != "chr"])


@query
def data_parameters(spark, d):
    m = calibrate.estimate_data_parameters(calls(spark, d), 0.5)
    return m.select(*[F.round(c, 8).alias(c) for c in m.columns])


@query
def pair_r2(spark, d):
    return thinning.pairwise_distance(bin_genotypes(spark, d, True), "r2", max_markers=thinning.HARD_CAP, per_chr=True)


def _rounded(c: str):
    """To eight places; most values of large tables are 0, whose decimal is not worth the way."""
    return F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.round(F.col(c) + 0.0, 8))


@query
def pair_mi(spark, d):
    return thinning.pairwise_distance(bin_genotypes(spark, d, True), "mi", max_markers=thinning.HARD_CAP, per_chr=True).withColumn("value", _rounded("value"))


@query
def pair_vi(spark, d):
    return thinning.pairwise_distance(bin_genotypes(spark, d, True), "vi", "bits", max_markers=thinning.HARD_CAP, per_chr=True).withColumn("value", _rounded("value"))


def _bins(spark, d) -> DataFrame:
    return bin_genotypes(spark, d).select("chr", "marker", F.col("bin").cast("double").alias("pos")).distinct()


@query
def position_distance_all(spark, d):
    """Markers of 5,000 parts; pairs of different chromosomes are infinitely far."""
    markers = obs(spark, d).selectExpr("chr", "chr * 1000000 + pos DIV 50000000 AS marker", "CAST(pos DIV 50000000 AS DOUBLE) AS pos").distinct()
    return thinning.position_distance(markers, max_markers=thinning.HARD_CAP)


@query
def position_distance_within(spark, d):
    return thinning.position_distance(_bins(spark, d), within=3.0)


@query
def independent_markers(spark, d):
    markers = _bins(spark, d)
    return thinning.select_independent(markers, thinning.position_distance(markers, within=3.0), 3.0, "distance", max_markers=thinning.HARD_CAP).where("set = 0").select("chr", F.col("marker").cast("long").alias("marker"))


@query
def independent_r2(spark, d):
    geno = bin_genotypes(spark, d, True)  # kept by the first reader: pairs and markers are both read from it
    related = thinning.pairwise_distance(geno, "r2", max_markers=thinning.HARD_CAP, per_chr=True, least=0.05)
    markers = geno.select("chr", "marker").coalesce(8)  # at most the ceiling of a chromosome, whatever the table
    return thinning.select_independent(markers, related, 0.05, n_runs=5, max_markers=thinning.HARD_CAP)


def _targets(spark, d) -> DataFrame:
    at = panel(spark, d).select("chr", "cm").distinct()
    return at.select("chr", F.explode(F.transform(F.array(*[F.lit(x) for x in (-0.5, 0.0, 0.25, 0.5)]), lambda x: x + F.col("cm"))).alias("cm")).distinct()


def _interp(mode: str) -> Query:
    return lambda spark, d: interpolate.interpolate_genotype(panel(spark, d), _targets(spark, d), mode)


_found |= {f"interp_{m}": _interp(m) for m in interpolate.MODES}


@query
def vcf_impute(spark, d):
    markers = spark.read.parquet(f"{d}/part.parquet").selectExpr("(p_partkey + 1) * 10000 AS pos", "p_brand AS ref", "p_type AS alt")
    markers = markers.join(spark.range(1, 8).selectExpr("CAST(id AS INT) AS chr"))
    states = calls(spark, d).where("g <> 3").withColumnRenamed("g", "state")
    return writers.vcf_lines(states, markers)[1]


@query
def painted_calls(spark, d):
    calls_ = segments.to_segments(calls(spark, d).where("g <> 3").withColumnRenamed("g", "state"))
    return segments.paint_calls(calls_.withColumn("panel", F.when(F.col("chr") <= 3, "a").otherwise("b")), "panel").select("name", "chr", "track", "x0", "x1", "y0", "y1", "state", "label")


def _pedigree(spark, d) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    lines = s.selectExpr("concat('S', CAST(s_suppkey AS STRING)) AS taxon", "concat('F', CAST(s_nationkey AS STRING)) AS family", "concat('G', CAST(s_nationkey AS STRING)) AS parent1")
    roots = s.selectExpr("concat('G', CAST(s_nationkey AS STRING)) AS taxon", "concat('F', CAST(s_nationkey AS STRING)) AS family", "CAST(NULL AS STRING) AS parent1").distinct()
    return lines.unionByName(roots)


@query
def design_priors(spark, d):
    """Expected genotypes of a design per supplier: backcrosses and selfings by its nation."""
    rows = []
    for k in range(30):
        name = f"BC{k % 5}S{k // 5}"
        p, (n_bc, n_self) = designs.breeding_prior(name), designs.parse_design(name)
        rows.append((k, name, p["REF"], p["HET"], p["ALT"], float(designs.founder_prior(name)[0]), float(designs.founder_prior(name)[1]), designs.expected_het(1 - 0.5**n_self), n_bc))
    table = spark.createDataFrame(rows, "k int, design string, p_ref double, p_het double, p_alt double, founder_ref double, founder_het double, het double, n_bc int")
    nation = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey", "CAST(s_nationkey % 30 AS INT) AS k")
    return nation.join(table, "k").drop("k")


@query
def family_of_line(spark, d):
    return readers.with_family(obs(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("markers")), _pedigree(spark, d))


# ------------------------------------------------------- checked by tests, not by SQL


@query
def binhmm_gauss(spark, d):
    return callers.call_states(obs(spark, d), "binhmm", design=DESIGN, bin_size=100_000)


@query
def binhmm_gmm(spark, d):
    return callers.call_states(obs(spark, d), "binhmm", design=DESIGN, bin_size=100_000, cluster_method="gmm", joint_clust=True, obs_weights=True)


@query
def binhmm_kmeans(spark, d):
    return callers.call_states(obs(spark, d), "binhmm", design=DESIGN, bin_size=100_000, cluster_method="kmeans")


@query
def bbnil_fitted_means(spark, d):
    return callers.call_ancestry(obs(spark, d), "bbnil", design=DESIGN, fit_means=True)


def _covered(spark, d, least: int) -> DataFrame:
    """Chains long enough for a rigid model."""
    rows = obs(spark, d).where("n_ref + n_alt > 0")
    return rows.join(rows.groupBy("name", "chr").count().where(F.col("count") >= least).drop("count"), ["name", "chr"], "left_semi")


@query
def rtiger(spark, d):
    return callers.call_ancestry(_covered(spark, d, 6), "rtiger", rigidity=3)


@query
def fsfhap_backcross(spark, d):
    return callers.call_ancestry(simulate.simulate_backcross_panel(spark, 60, 600, 2), "fsfhap", design="BC1S4")


@query
def fsfhap_biparental(spark, d):
    return callers.call_ancestry(simulate.simulate_backcross_panel(spark, 80, 600, 2, donor_frac=0.5, phet=0.0, miss=0.05), "fsfhap", design="BC0S4")


@query
def pedigree_states(spark, d):
    return callers.call_states(obs(spark, d), "pedigree", design=DESIGN, pedigree=_pedigree(spark, d), rrate=1e-8)


@query
def refined_ancestry(spark, d):
    states = callers.call_states(obs(spark, d), "bbnil", design=DESIGN)
    return callers.refine_ancestry(states, _pedigree(spark, d), DESIGN, rrate=1e-8)


@query
def simulated_lines(spark, d):
    truth = simulate.simulate_nil(spark, "BC2S2", 20, n_markers=1000)
    return simulate.simulate_counts(truth, depth=2.0)


@query
def simulated_family(spark, d):
    return simulate.simulate_family(spark, "BC2S3", 2, 5, n_markers=500)[0]


@query
def marker_grid(spark, d):
    return maps.build_marker_grid(readers.load_map(spark), 2000)


@query
def map_positions(spark, d):
    table = readers.load_map(spark)
    at = obs(spark, d).select("chr", "pos").distinct()
    cm = maps.bp_to_cm(table).column(F.col("chr"), F.col("pos"))
    return at.withColumn("cm", cm).withColumn("bp", maps.cm_to_bp(table).column(F.col("chr"), F.col("cm")))


@query
def calibrated_rate(spark, d):
    sim = segments.donor_blocks(callers.call_states(obs(spark, d), "bbnil", design=DESIGN, rrate=0.005)).select("mb")
    best = calibrate.calibrate_r(obs(spark, d), sim, [0.001, 0.005, 0.02], design=DESIGN)
    return best.select("value", F.round("d", 9).alias("d"), "n_blocks", F.round("median_mb", 9).alias("median_mb"), "at_grid_edge")


@query
def parameter_grid(spark, d):
    m = calibrate.optimize_parameters(calls(spark, d), {"nir": (0.01, 0.1), "germ": (0.01,), "gert": (0.05,), "p": (0.5,), "r_multiplier": (1.0, 2.0)})
    return m.select("combo", "nir", "germ", "gert", "p", "r_multiplier", *[F.round(c, 8).alias(c) for c in m.columns if c.startswith(("pct", "mean", "sd"))])


@query
def introgressions(spark, d):
    return segments.to_segments(calibrate.call_introgressions(calls(spark, d), "low"))


def queries() -> dict[str, Query]:
    return {**_found, **files.QUERIES}
