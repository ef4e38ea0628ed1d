"""Genotyping files as DataFrames, parsed by Spark expressions where the format is
text and by an Arrow kernel where it is packed bits."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..schema import chromosome

#: IUPAC code of a heterozygote of two bases in order.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


class FormatError(ValueError):
    """A file is not what its format says."""


def _base_name(path: Column) -> Column:
    """File name up to its first dot."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def read_counts(spark: SparkSession, path: str, format: str = "tsv", name: str | None = None, strict_biallelic: bool = False) -> DataFrame:
    """Read counts (name, chr, pos, n_ref, n_alt).

    tsv: headerless chr, pos, ref, n_ref, alt, n_alt; a file, or a folder of *.tsv and
    *.tsv.gz; the sample is ``name`` or the file name up to its first dot.
    vcf_ad: the AD field of a VCF; see read_vcf_counts. gatk_table: not implemented."""
    if format == "vcf_ad":
        return read_vcf_counts(spark, path, strict_biallelic)
    if format == "gatk_table":
        raise NotImplementedError("read_counts: format 'gatk_table' is not yet implemented; use 'tsv' or 'vcf_ad'")
    if format != "tsv":
        raise ValueError("read_counts: format must be tsv, vcf_ad or gatk_table")
    schema = "chr string, pos long, ref string, n_ref int, alt string, n_alt int"
    rows = spark.read.schema(schema).option("sep", "\t").option("pathGlobFilter", "*.tsv*").csv(path)
    sample = F.lit(name) if name is not None else F.regexp_replace(_base_name(F.col("_metadata.file_path")), r"\..*$", "")
    return rows.select(sample.alias("name"), chromosome(F.col("chr")).alias("chr"), "pos", "n_ref", "n_alt")


def vcf_header(spark: SparkSession, path: str, who: str = "vcf") -> list[str]:
    """Sample names. Only the header line leaves the executors."""
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    if not head:
        raise FormatError(f"{who}: no #CHROM header found in {path}")
    names = head[0].value.rstrip("\r").split("\t")
    if len(names) < 10:
        raise FormatError(f"{who}: the VCF has no sample (FORMAT) columns")
    return names[9:]


def _vcf_cells(spark: SparkSession, path: str, samples: list[str], keep: list[str] | None = None) -> DataFrame:
    """(name, chr, pos, ref, alt, qual, format, cell) of every record and sample. The
    line splits once; only the chosen samples explode."""
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(fields.alias("f"))
    # two literals whatever the cohort's size: the names and the columns of the chosen samples
    names = F.lit([s for s in samples if keep is None or s in keep])
    places = F.lit([9 + i for i, s in enumerate(samples) if keep is None or s in keep])
    cells = F.zip_with(names, places, lambda n, i: F.struct(n.alias("name"), F.get("f", i).alias("cell")))
    at = lambda k: F.get("f", F.lit(k))
    rows = lines.select(chromosome(at(0)).alias("chr"), at(1).try_cast("long").alias("pos"), at(3).alias("ref"), at(4).alias("alt"), at(5).try_cast("double").alias("qual"), at(8).alias("format"), F.explode(cells).alias("s"))
    return rows.select("s.name", "chr", "pos", "ref", "alt", "qual", "format", "s.cell")


def read_vcf_counts(spark: SparkSession, path: str, strict_biallelic: bool = False) -> DataFrame:
    """AD counts of a VCF. The field's place is looked up in every record's FORMAT; a
    missing or cut field is 0, 0; of several alternatives the first counts. With
    ``strict_biallelic`` records of several alternatives or without AD are skipped."""
    cells = _vcf_cells(spark, path, vcf_header(spark, path, "read_counts(vcf_ad)"))
    at = F.array_position(F.split("format", ":"), F.lit("AD")).cast("int")
    forms = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.get(F.split("value", "\t", 10), F.lit(8)).alias("format"))
    seen = forms.agg(F.count(F.lit(1)).alias("n"), F.count_if(at > 0).alias("k")).first()
    if not seen.n:
        raise FormatError("read_counts(vcf_ad): the VCF has no records")
    if not seen.k:
        raise FormatError("read_counts(vcf_ad): no `AD` field found in the FORMAT column")
    if seen.k < seen.n and not strict_biallelic:
        warnings.warn("read_counts(vcf_ad): records without AD in FORMAT are read as 0 counts", stacklevel=2)
    if strict_biallelic:
        cells = cells.where((at > 0) & ~F.col("alt").contains(","))
    depth = F.split(F.when(at > 0, F.get(F.split("cell", ":"), at - 1)), ",")
    count = lambda k: F.coalesce(F.get(depth, F.lit(k)).try_cast("int"), F.lit(0))
    return cells.select("name", "chr", "pos", count(0).alias("n_ref"), count(1).alias("n_alt"))


def read_vcf_gt(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """Genotypes (name, chr, pos, g): g counts alleles other than 0, 3 is missing. A
    haploid call counts for both alleles."""
    names = vcf_header(spark, path, "read_vcf_gt")
    if samples is not None and not set(samples) & set(names):
        raise FormatError("read_vcf_gt: none of `samples` present in the VCF")
    cells = _vcf_cells(spark, path, names, samples)
    gt = F.regexp_extract("cell", "^([^:]*)", 1)
    a, b = F.regexp_extract(gt, "^([^/|]*)", 1), F.regexp_extract(gt, "([^/|]*)$", 1)
    g = F.when((a == ".") | (b == "."), 3).otherwise((a != "0").cast("int") + (b != "0").cast("int"))
    return cells.select("name", "chr", "pos", F.coalesce(g, F.lit(3)).alias("g"))


def filter_vcf(spark: SparkSession, path: str, min_qual: float | None = None, max_missing: float | None = None, chromosomes: list[int] | None = None, samples: list[str] | None = None, snps_only: bool = False) -> DataFrame:
    """Cells of the records that pass: quality, share of missing genotypes among the
    chosen samples, chromosomes, biallelic single-base variants."""
    names = vcf_header(spark, path, "filter_vcf")
    cells = _vcf_cells(spark, path, names, samples)
    if min_qual is not None:
        cells = cells.where(F.col("qual") >= min_qual)
    if chromosomes is not None:
        cells = cells.where(F.col("chr").isin(chromosomes))
    if snps_only:
        cells = cells.where((F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("alt") != "."))
    if max_missing is not None:
        gone = F.regexp_extract("cell", "^([^:]*)", 1).contains(".").cast("int")
        good = cells.groupBy("chr", "pos", "ref", "alt").agg(F.avg(gone).alias("m")).where(F.col("m") <= max_missing)
        cells = cells.join(good.drop("m"), ["chr", "pos", "ref", "alt"], "left_semi")
    return cells


def subset_by_group(cells: DataFrame, metadata: DataFrame, column: str, value: str, sample: str = "name") -> DataFrame:
    """Rows of the samples whose metadata ``column`` is ``value``."""
    wanted = metadata.where(F.col(column) == value).select(F.col(sample).alias("name")).distinct()
    return cells.join(wanted, "name", "left_semi")


def read_hapmap(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """HapMap genotypes: one-letter IUPAC calls, or two letters; of 'A/C' the first
    base's homozygote is 0. Anything else is 3."""
    table = spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    if len(table.columns) < 12 or table.columns[0] != "rs#":
        raise FormatError("read_hapmap: not a HapMap file ('rs#' header and a taxon column)")
    taxa = table.columns[11:]
    keep = [t for t in taxa if samples is None or t in samples]
    if not keep:
        raise FormatError("read_hapmap: none of `samples` present")
    quoted = lambda c: F.col(f"`{c}`")
    cells = F.array(*[F.struct(F.lit(t).alias("name"), quoted(t).alias("call")) for t in keep])
    rows = table.select(chromosome(F.col("chrom")).alias("chr"), F.col("pos").try_cast("long").alias("pos"), F.substring("alleles", 1, 1).alias("a"), F.substring("alleles", 3, 1).alias("b"), F.explode(cells).alias("s"))
    a, b, call = F.col("a"), F.col("b"), F.col("s.call")
    code = F.element_at(F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv]), F.concat(F.least(a, b), F.greatest(a, b)))
    one = F.when(call == a, 0).when(call == b, 2).when(call == code, 1).otherwise(3)
    two = F.when(call == F.concat(a, a), 0).when(call == F.concat(b, b), 2).when((call == F.concat(a, b)) | (call == F.concat(b, a)), 1).otherwise(3)
    return rows.select("s.name", "chr", "pos", F.when(F.length(call) == 2, two).otherwise(one).alias("g"))


def _numbered_lines(lines: DataFrame, keep: list[str], schema: str) -> tuple[DataFrame, int]:
    """(rows with their place ``n`` in the file, number of rows) of one file's rows, whose
    column ``at`` is where their split begins. A split is read in order by one task; they are
    kept, so that the splits that were counted are those that are numbered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            at, k = b.column(b.schema.get_field_index("at")).to_numpy(), np.zeros(len(b), np.int64)
            for start in np.unique(at).tolist():
                here = np.flatnonzero(at == start)
                k[here] = np.arange(len(here)) + seen.get(start, 0)
                seen[start] = seen.get(start, 0) + len(here)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(k), *[b.column(b.schema.get_field_index(c)) for c in keep]], names=["at", "k", *keep])

    rows = lines.select("at", *keep).mapInArrow(count, f"at long, k long, {schema}").persist(StorageLevel.MEMORY_AND_DISK)
    before, total = [], 0
    for r in rows.groupBy("at").count().orderBy("at").collect():
        before.append((r.at, total))
        total += r["count"]
    first = rows.sparkSession.createDataFrame(before, "at long, first long")
    return rows.join(F.broadcast(first), "at").select((F.col("first") + F.col("k")).alias("n"), *keep), total


def read_plink(spark: SparkSession, prefix: str) -> DataFrame:
    """A .bed/.bim/.fam trio as (name, chr, pos, g): dosage of allele A1, 3 missing.

    The packed file is one binary row, cut into a row a variant; variants and their lines
    in .bim meet by number on the executors, the driver holds the samples alone. Its size
    is checked against the other two before anything is unpacked."""
    prefix = prefix.removesuffix(".bed")
    words = lambda path: spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"), F.col("_metadata.file_block_start").alias("at")).where(F.size("w") > 1)
    fam = [r.n for r in words(f"{prefix}.fam").select(F.get("w", F.lit(1)).alias("n")).collect()]
    width = -(-len(fam) // 4)
    bed = spark.read.format("binaryFile").load(f"{prefix}.bed")
    size = bed.select("length").first().length
    head = bed.select(F.substring("content", 1, 3).alias("h")).first().h
    if len(head) < 3 or bytes(head[:2]) != b"\x6c\x1b":
        raise FormatError("read_plink: not a valid PLINK .bed (bad magic bytes)")
    if head[2] != 1:
        raise FormatError("read_plink: only SNP-major .bed is supported")
    bim = words(f"{prefix}.bim").select("at", chromosome(F.get("w", F.lit(0))).alias("chr"), F.get("w", F.lit(3)).try_cast("long").alias("pos"))
    sites, variants = _numbered_lines(bim, ["chr", "pos"], "chr int, pos long")
    if size != 3 + variants * width:
        raise FormatError(f"read_plink: .bed size inconsistent with .bim and .fam (expected {3 + variants * width} bytes, got {size})")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = max(1, min(65_536, 4_000_000 // max(1, width)))
        for b in batches:
            for content in b.column(0):
                raw = memoryview(content.as_buffer())[3:]
                for i in range(0, variants, block):
                    n = min(block, variants - i)
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * width).buffers()[1]
                    bits = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(raw[i * width : (i + n) * width])])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n)), bits], names=["n", "bits"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dosage, names = np.array([2, 3, 1, 0], np.int32), pa.array(fam, pa.string())  # fixed values of the two-bit codes
        block = max(1, 1_000_000 // max(1, len(fam)))
        for b in batches:
            for i in range(0, len(b), block):
                chrom, pos, bits = b.slice(i, block).columns
                n = len(bits)
                raw = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(n, width)
                codes = (raw[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
                g = dosage[codes.reshape(n, -1)[:, : len(fam)]]
                site = pa.array(np.repeat(np.arange(n), len(fam)))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.tile(np.arange(len(fam)), n))), chrom.take(site), pos.take(site), pa.array(g.ravel())], names=["name", "chr", "pos", "g"])

    packed = bed.select("content").mapInArrow(cut, "n long, bits binary")
    return sites.join(packed, "n").select("chr", "pos", "bits").mapInArrow(unpack, "name string, chr int, pos long, g int")


def read_pedigree(spark: SparkSession, path: str, format: str = "fsfhap") -> DataFrame:
    """(taxon, family, parent1, parent2, contribution1, contribution2, F). fsfhap: TSV
    with a header, columns by place; fam: white-space separated without a header."""
    cols = ("taxon", "family", "parent1", "parent2")
    if format == "fsfhap":
        table = spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
        n = len(table.columns)
        if n < 4:
            raise FormatError("read_pedigree: a pedigree needs >= 4 columns (family taxon parent1 parent2)")
        table = table.toDF(*[f"c{i}" for i in range(n)])
        at = lambda i: F.col(f"c{i}") if i < n else F.lit(None)
        text = [at(i).cast("string").alias(c) for c, i in zip(cols, (1, 0, 2, 3))]
        return table.select(*text, *[at(i).cast("string").try_cast("double").alias(c) for c, i in (("contribution1", 4), ("contribution2", 5), ("F", 6))])
    if format == "fam":
        rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.split(F.trim("value"), r"\s+").alias("w"))
        if rows.where(F.size("w") < 2).limit(1).count():
            raise FormatError("read_pedigree: .fam needs >= 2 columns (FID IID ...)")
        get = lambda i: F.get("w", F.lit(i))
        return rows.select(get(1).alias("taxon"), get(0).alias("family"), get(2).alias("parent1"), get(3).alias("parent2"), *[F.lit(None).cast("double").alias(c) for c in ("contribution1", "contribution2", "F")])
    raise ValueError("read_pedigree: format must be fsfhap or fam")


def with_family(data: DataFrame, pedigree: DataFrame) -> DataFrame:
    """``data`` with the family of its taxon; null where the pedigree has none."""
    return data.join(pedigree.select(F.col("taxon").alias("name"), "family").distinct(), "name", "left")


def load_map(spark: SparkSession, path: str | None = None, version: str = "synthetic", chromosomes: int = 10) -> DataFrame:
    """A genetic map (locus, chr, cm, bp): a user's file (parquet, or CSV with a
    header), or the synthetic default, whose recombination is low mid-chromosome."""
    if path is not None:
        table = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", "true").csv(path)
        return table.select(F.col("locus").cast("string").alias("locus"), chromosome(F.col("chr")).alias("chr"), F.col("cm").cast("double").alias("cm"), F.col("bp").cast("double").alias("bp"))
    if version != "synthetic":
        raise ValueError(f"load_map: only the synthetic map is bundled; got {version!r}. Pass a path to a map of your own")
    loci = spark.range(chromosomes * 201).select((F.col("id").cast("int") % 201).alias("i"), (F.floor(F.col("id") / 201) + 1).cast("int").alias("chr"))
    x = F.col("i") / 200
    cm = 150 * (0.2 * x + 0.8 * (0.5 + 4 * F.pow(x - 0.5, 3)))
    return loci.select(F.concat(F.lit("m"), "chr", F.lit("_"), "i").alias("locus"), "chr", cm.alias("cm"), (1 + x * (300e6 - 1e7 * F.col("chr"))).alias("bp"))
