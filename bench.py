"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from mosaic_spark.operators import callers, simulate
    from mosaic_spark.plans import queries as plans
    from mosaic_spark.plans import views

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.maxRecordsPerBatch", "65536").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(df_of, repeat: int = 2) -> float:
        best = float("inf")
        for _ in range(repeat):
            t = time.time()
            df_of().write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - t)
        return round(best, 3)

    obs = views.obs(spark, sf).persist()
    cells = obs.count()
    # a cohort of the size of the published count-caller figure
    lines, markers, chroms = 256, 4_900, 10
    i = F.col("id")
    cohort = spark.range(lines * markers * chroms).select(
        F.concat(F.lit("L"), F.floor(i / (markers * chroms)).cast("string")).alias("name"), (F.floor(i / markers) % chroms + 1).cast("int").alias("chr"), ((i % markers + 1) * 1000).cast("int").alias("pos"),
        (F.pmod(F.xxhash64("id"), F.lit(3))).cast("int").alias("n_ref"), F.when(F.pmod(F.floor(i / 700), F.lit(7)) == 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3))).otherwise(0).cast("int").alias("n_alt"),
    ).persist()
    cohort_cells = cohort.count()
    panel = simulate.simulate_backcross_panel(spark, 500, 1_000, 5).persist()
    panel_cells = panel.count()
    run = {
        "bbnil_view": lambda: callers.call_ancestry(obs, "bbnil", design="BC2S3"),
        "bbnil_cohort_states": lambda: callers.call_states(cohort, "bbnil", design="BC2S3"),
        "lbimpute_view": lambda: callers.call_ancestry(obs, "lbimpute"),
        "atlas_view": lambda: callers.call_ancestry(obs, "atlas", design="BC2S3"),
        "binhmm_view": lambda: callers.call_ancestry(obs, "binhmm", design="BC2S3", bin_size=100_000),
        "fsfhap_panel": lambda: callers.call_ancestry(panel, "fsfhap", design="BC1S4"),
        "genotype_hwe": lambda: plans.queries()["genotype_hwe"](spark, sf),
        "pair_r2": lambda: plans.queries()["pair_r2"](spark, sf),
        "segments_calls": lambda: plans.queries()["segments_calls"](spark, sf),
        "vcf_impute": lambda: plans.queries()["vcf_impute"](spark, sf),
    }
    timed(run["bbnil_view"], 1)
    found = {name: timed(f) for name, f in run.items()}
    rate = lambda n, name: round(n / found[name] / 1e6, 2)
    million_cells = {"bbnil_view": rate(cells, "bbnil_view"), "bbnil_cohort_states": rate(cohort_cells, "bbnil_cohort_states"), "fsfhap_panel": rate(panel_cells, "fsfhap_panel")}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "million_cells_per_sec": million_cells, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
