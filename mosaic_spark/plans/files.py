"""Queries that write files of a format and read them back: the tables' reads pooled by
return flag and line status, a handful of samples whatever the tables' size."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators import callers
from ..sources import readers, writers
from .views import CALLS, obs, pooled

#: Fixed values of the written files: two alleles at every site.
REF, ALT = "A", "C"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which driver and executors share."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    base = have.get() if have.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="mosaic-files-")  # this machine is all there is
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return lambda p: path(p).getFileSystem(conf), path


def _genotypes(spark: SparkSession, d: str) -> DataFrame:
    return pooled(spark, d).selectExpr("*", f"CAST({CALLS} AS INT) AS g")


def _wide(rows: DataFrame, cell, absent: str) -> tuple[list[str], DataFrame]:
    """(samples, (chr, pos, cells)): the text cells of all samples at every site."""
    names = [r.name for r in rows.select("name").distinct().orderBy("name").collect()]
    one = [F.coalesce(F.max(F.when(F.col("name") == n, cell)), F.lit(absent)) for n in names]
    return names, rows.groupBy("chr", "pos").agg(F.concat_ws("\t", *one).alias("cells"))


def _write_vcf(spark: SparkSession, d: str, cell, absent: str, form: str) -> str:
    names, sites = _wide(_genotypes(spark, d), cell, absent)
    dot = F.lit(".")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), "chr"), "pos", dot, F.lit(REF), F.when(F.col("pos") % 7 == 0, F.lit(f"{ALT},G")).otherwise(F.lit(ALT)), (F.col("pos") / 10_000 % 50).cast("int"), dot, dot, F.lit(form), "cells")
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])
    top = spark.createDataFrame([("##fileformat=VCFv4.2",), (head,)], "value string")
    path = folder(spark, "vcf")
    top.coalesce(1).unionByName(sites.select(line.alias("value"))).write.text(path)
    return path


def counts_tsv(spark: SparkSession, d: str) -> DataFrame:
    """A headerless file per sample, named after it."""
    path = folder(spark, "counts")
    rows = pooled(spark, d).select("name", F.concat_ws("\t", F.concat(F.lit("chr"), "chr"), "pos", F.lit(REF), "n_ref", F.lit(ALT), "n_alt").alias("value"))
    rows.write.partitionBy("name").text(path)
    files, at = _files(spark)
    fs = files(path)
    for part in fs.listStatus(at(path)):
        name = part.getPath().getName()
        if name.startswith("name="):
            for k, f in enumerate(fs.globStatus(at(f"{path}/{name}/part-*"))):
                fs.rename(f.getPath(), at(f"{path}/{name[5:]}.{k}.tsv"))
            fs.delete(part.getPath(), True)
    return readers.read_counts(spark, path)


def _reads():
    return F.concat_ws(":", F.lit("./."), F.concat_ws(",", "n_ref", "n_alt"))


def _calls():
    return F.element_at(F.array(*[F.lit(x) for x in ("0/0", "0|1", "1/1", "./.")]), F.col("g") + 1)


def vcf_ad(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_counts(spark, _write_vcf(spark, d, _reads(), "./.", "GT:AD"), format="vcf_ad")


def vcf_ad_biallelic(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_counts(spark, _write_vcf(spark, d, _reads(), "./.", "GT:AD"), format="vcf_ad", strict_biallelic=True)


def vcf_gt(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_vcf_gt(spark, _write_vcf(spark, d, _calls(), "./.", "GT"))


def vcf_gt_samples(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_vcf_gt(spark, _write_vcf(spark, d, _calls(), "./.", "GT"), samples=["NO", "RF", "absent"])


def vcf_filtered(spark: SparkSession, d: str) -> DataFrame:
    cells = readers.filter_vcf(spark, _write_vcf(spark, d, _calls(), "./.", "GT"), min_qual=20, max_missing=0.5, chromosomes=[1, 2, 3, 5], snps_only=True)
    groups = spark.createDataFrame([("AF", "first"), ("NF", "first"), ("NO", "second"), ("RF", "second")], "name string, panel string")
    return readers.subset_by_group(cells, groups, "panel", "second").select("name", "chr", "pos", "ref", "alt", "qual", "cell")


def hapmap(spark: SparkSession, d: str) -> DataFrame:
    letter = F.element_at(F.array(*[F.lit(x) for x in (REF, "M", ALT, "N")]), F.col("g") + 1)
    names, sites = _wide(_genotypes(spark, d), letter, "N")
    head = ["rs#", "alleles", "chrom", "pos", "strand", "assembly#", "center", "protLSID", "assayLSID", "panelLSID", "QCcode", *names]
    line = F.concat_ws("\t", F.concat(F.lit("m"), "chr", F.lit("_"), "pos"), F.lit(f"{REF}/{ALT}"), F.col("chr"), F.col("pos"), *[F.lit("NA")] * 7, "cells")
    path = folder(spark, "hapmap")
    # a file begins with the header, so one task writes the samples' lines
    top = spark.createDataFrame([(-1, -1, "\t".join(head))], "chr int, pos long, value string")
    top.unionByName(sites.select("chr", "pos", line.alias("value"))).coalesce(1).sortWithinPartitions("chr", "pos").select("value").write.text(path)
    return readers.read_hapmap(spark, path)


def plink(spark: SparkSession, d: str) -> DataFrame:
    """Two bits a sample, so two bytes a variant at most."""
    code = F.element_at(F.array(*[F.lit(x) for x in (3, 2, 0, 1)]), F.col("g") + 1)
    names, sites = _wide(_genotypes(spark, d), code.cast("string"), "1")
    bits = F.split("cells", "\t")
    packed = [sum(F.get(bits, F.lit(k)).cast("int") * 4 ** (k % 4) for k in range(i, min(i + 4, len(names)))).alias(f"b{i}") for i in range(0, len(names), 4)]
    base = folder(spark, "plink")
    kept = sites.select("chr", "pos", *packed).persist(StorageLevel.MEMORY_AND_DISK)  # two files are written from it
    order = kept.orderBy("chr", "pos")
    order.select(F.concat_ws("\t", "chr", F.concat(F.lit("m"), "pos"), F.lit("0"), "pos", F.lit(ALT), F.lit(REF)).alias("value")).coalesce(1).write.text(f"{base}/bim")
    spark.createDataFrame([(f"F {n} 0 0 0 -9",) for n in names], "value string").coalesce(1).write.text(f"{base}/fam")
    files, at = _files(spark)
    fs = files(base)
    for kind in ("bim", "fam"):
        fs.rename(fs.globStatus(at(f"{base}/{kind}/part-*"))[0].getPath(), at(f"{base}/x.{kind}"))
        fs.delete(at(f"{base}/{kind}"), True)
    out = fs.create(at(f"{base}/x.bed"))
    out.write(bytearray([0x6C, 0x1B, 1]))
    for batch in order.drop("chr", "pos").toArrow().to_batches():
        out.write(bytearray(np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(np.uint8).tobytes()))
    out.close()
    kept.unpersist()
    return readers.read_plink(spark, f"{base}/x")


def pedigree_table(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/supplier.parquet").selectExpr(
        "concat('F', CAST(s_nationkey AS STRING)) AS family", "concat('S', CAST(s_suppkey AS STRING)) AS taxon", "concat('G', CAST(s_nationkey AS STRING)) AS parent1",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'B73' END AS parent2", "0.75 AS p1", "0.25 AS p2", "CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE CAST(CAST(s_suppkey % 4 AS DOUBLE) / 4 AS STRING) END AS F")
    path = folder(spark, "pedigree")
    rows.write.option("sep", "\t").option("header", "true").csv(path)
    return readers.read_pedigree(spark, path)


def pedigree_fam(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("concat('  F', CAST(s_nationkey AS STRING), '  S', CAST(s_suppkey AS STRING), ' G1 G2 0 -9') AS value")
    path = folder(spark, "fam")
    rows.write.text(path)
    return readers.read_pedigree(spark, path, "fam")


def segments_file(spark: SparkSession, d: str) -> DataFrame:
    calls = callers.call_ancestry(obs(spark, d), "bbnil", design="BC2S3", donor="teo")
    path = writers.write_common_schema(calls, folder(spark, "segments"))
    return spark.read.option("header", "true").csv(path, schema="source string, donor string, name string, chr int, start_bp long, end_bp long, state int")


def imputed_vcf_file(spark: SparkSession, d: str) -> DataFrame:
    states = _genotypes(spark, d).where("g <> 3").withColumnRenamed("g", "state")
    markers = states.selectExpr("chr", "pos", f"'{REF}' AS ref", f"'{ALT}' AS alt").distinct()
    return readers.read_vcf_gt(spark, writers.write_vcf_impute(states, folder(spark, "imputed"), markers))


def results_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the four result tables, counted, and their sums."""
    states = _genotypes(spark, d).where("g <> 3").withColumnRenamed("g", "state")
    path = writers.write_results(states, folder(spark, "results"), {"caller": "none", "r": 0.01})
    read = lambda name: spark.read.option("header", "true").option("inferSchema", "true").csv(f"{path}/{name}")
    parts = [
        read("calls").agg(F.lit("calls").alias("file"), F.count(F.lit(1)).alias("n"), F.sum("state").cast("long").alias("total")),
        read("summary").agg(F.lit("summary").alias("file"), F.count(F.lit(1)).alias("n"), F.sum(F.col("n_het") + 2 * F.col("n_alt")).cast("long").alias("total")),
        read("markers").agg(F.lit("markers").alias("file"), F.count(F.lit(1)).alias("n"), F.sum("pos").cast("long").alias("total")),
        read("parameters").agg(F.lit("parameters").alias("file"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("total")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


QUERIES = {f"file_{f.__name__}": f for f in (counts_tsv, vcf_ad, vcf_ad_biallelic, vcf_gt, vcf_gt_samples, vcf_filtered, hapmap, plink, pedigree_table, pedigree_fam, segments_file, imputed_vcf_file, results_files)}
