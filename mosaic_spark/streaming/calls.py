"""Calls on streams of count files.

Per-site genotypes need no state, so they run inside a stream. Chain callers need
whole chains: a sample's file arrives whole, so each micro-batch is called as a
small cohort and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.genotype import call_gt
from ..operators.callers import call_ancestry
from ..schema import chromosome


def stream_counts(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over a folder of count TSVs; the sample is the file name."""
    schema = "chr string, pos long, ref string, n_ref int, alt string, n_alt int"
    rows = spark.readStream.schema(schema).option("sep", "\t").option("maxFilesPerTrigger", files_per_batch).csv(path)
    name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1), r"\..*$", "")
    return rows.select(name.alias("name"), chromosome(F.col("chr")).alias("chr"), "pos", "n_ref", "n_alt")


def stream_genotypes(counts: DataFrame, prior="flat", **params) -> DataFrame:
    """Streamed per-site genotypes, with a prior that needs no other rows."""
    if prior == "hwe" and "af" not in params:
        raise ValueError("stream_genotypes: an estimated prior needs the whole marker; give `af`, weights, or 'flat'")
    return call_gt(counts, prior, **params)


def stream_ancestry(counts: DataFrame, out: str, checkpoint: str, caller: str = "bbnil", trigger: dict | None = None, **params) -> StreamingQuery:
    """Appends the segments of every micro-batch to parquet at ``out``."""

    def write(batch: DataFrame, number: int) -> None:
        call_ancestry(batch, caller, **params).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
