"""Observation views derived from the driver's tables, in integer arithmetic so that
any engine gives the same rows. Lines are suppliers, chromosomes are line numbers,
markers are parts; ``ST`` plants the true states in blocks of parts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import column, whole_units

BLOCK, SPACING = 200, 10_000

#: {div} is the engine's integer division, {pos} its type of positions: 64 bits in Spark,
#: as markers times spacing outgrow 32 bits.
OBS = f"""
SELECT concat('S', CAST(s AS STRING)) AS name, chr, CAST((p + 1) * {SPACING} AS {{pos}}) AS pos,
  CAST(n - a AS INT) AS n_ref, CAST(a AS INT) AS n_alt
FROM (
  SELECT s, chr, p, n, CASE WHEN k < 7 THEN least(e, n) WHEN k = 7 THEN n {{div}} 2 ELSE n - least(e, n) END AS a
  FROM (
    SELECT l_suppkey AS s, CAST(l_linenumber AS INT) AS chr, l_partkey AS p, (l_partkey {{div}} {BLOCK} + l_suppkey) % 10 AS k,
      SUM(CAST(l_quantity AS INT) % 6) AS n,
      SUM(CASE WHEN CAST(ROUND(l_discount * 100) AS INT) = 10 AND CAST(l_quantity AS INT) % 6 > 0 THEN 1 ELSE 0 END) AS e
    FROM {{lineitem}} GROUP BY l_suppkey, CAST(l_linenumber AS INT), l_partkey
  ) q
) r
"""

#: Genotype calls of the view: missing without reads, heterozygous with both alleles.
CALLS = "CASE WHEN n_ref + n_alt = 0 THEN 3 WHEN n_alt = 0 THEN 0 WHEN n_ref = 0 THEN 2 ELSE 1 END"

#: Bins of 100 parts as markers with a rounded dosage.
BIN_GENO = f"""
SELECT chr, chr * 1000000 + bin AS marker, bin, name AS sample, CAST((4 * a + d) {{div}} (2 * d) AS INT) AS dosage
FROM (SELECT name, chr, pos {{div}} {SPACING * 100} AS bin, SUM(n_alt) AS a, SUM(n_ref + n_alt) AS d FROM {{obs}} GROUP BY name, chr, pos {{div}} {SPACING * 100}) b
WHERE d > 0
"""

#: A complete panel for interpolation: line status and return flag as samples.
PANEL = """
SELECT chr, CAST(bin AS DOUBLE) AS cm, sample, CAST(q % 3 AS DOUBLE) AS dosage
FROM (SELECT CAST(l_linenumber AS INT) AS chr, l_partkey {div} 100 AS bin, l_linestatus AS sample, SUM(CAST(l_quantity AS INT)) AS q
      FROM {lineitem} GROUP BY CAST(l_linenumber AS INT), l_partkey {div} 100, l_linestatus) b
"""


#: Reads pooled by return flag and line status: a handful of samples at any size.
POOLED = f"""
SELECT name, chr, pos, CAST(r AS INT) AS n_ref, CAST(a AS INT) AS n_alt FROM (
  SELECT concat(l_returnflag, l_linestatus) AS name, CAST(l_linenumber AS INT) AS chr, CAST((l_partkey + 1) * {SPACING} AS {{pos}}) AS pos,
    SUM(CAST(l_quantity AS INT) % 3) AS r, SUM(CAST(ROUND(l_discount * 100) AS INT) % 3) AS a
  FROM {{lineitem}} GROUP BY concat(l_returnflag, l_linestatus), CAST(l_linenumber AS INT), l_partkey) q
"""


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(text.format(lineitem="{lineitem}", div="DIV", pos="BIGINT"), lineitem=lineitem)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, OBS)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PANEL)


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, POOLED)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).selectExpr("*", f"CAST({CALLS} AS INT) AS g")


def _divided(x, y):
    """The engine's integer division, which drops the fraction."""
    return (x - np.fmod(x, y)) // y


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _order(*keys: np.ndarray) -> np.ndarray:
    """Rows by their keys, the first one first: by one number where it has room for all."""
    keys = [k.astype(np.int64) for k in keys]
    low = [int(k.min()) for k in keys]
    wide = [int(k.max()) - m + 1 for k, m in zip(keys, low)]
    if math.prod(wide) >= 2**63:
        return np.lexsort(keys[::-1])
    one = np.zeros(len(keys[0]), np.int64)
    for k, m, w in zip(keys, low, wide):
        one = one * w + (k - m)
    return np.argsort(one)


def _marker_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines (marker, chr, s, p, qe) by marker: (chr, marker, codes, values), the suppliers and
    dosages of ``BIN_GENO``'s rows. qe is twice the quantity and one more for a discounted line.
    Lines without a supplier make a marker, but no cell that others could share."""
    for whole in whole_units(batches, ["marker"]):
        s = whole.column(whole.schema.get_field_index("s"))
        absent = s.is_null().to_numpy(zero_copy_only=False)
        s = s.fill_null(0).to_numpy()
        marker, chrom, p, qe = (column(whole, c).astype(np.int64) for c in ("marker", "chr", "p", "qe"))
        order = _order(marker, chrom, absent, s, p)
        marker, chrom, absent, s, p, qe = (x[order] for x in (marker, chrom, absent, s, p, qe))
        at = _changes(p, s, absent, chrom, marker)  # parts of a line
        n, e = np.add.reduceat(qe >> 1, at), np.add.reduceat(qe & 1, at)
        marker, chrom, absent, s, p = (x[at] for x in (marker, chrom, absent, s, p))
        kind = np.where(absent, 8, np.fmod(_divided(p, BLOCK) + s, 10))
        least = np.minimum(e, n)
        alt = np.where(kind < 7, least, np.where(kind == 7, _divided(n, 2), n - least))
        at = _changes(s, absent, chrom, marker)  # bins of a line
        a, d = np.add.reduceat(alt, at), np.add.reduceat(n, at)
        at, a, d = at[d > 0], a[d > 0], d[d > 0]
        if not len(at):
            continue
        marker, chrom, known, s = marker[at], chrom[at], ~absent[at], s[at]
        first = _changes(chrom, marker)
        ends = np.append(0, np.cumsum(np.add.reduceat(known.astype(np.int64), first))).astype(np.int32)
        lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x[known])) for x in (s, _divided(4 * a + d, 2 * d).astype(float)))
        yield pa.RecordBatch.from_arrays([pa.array(chrom[first].astype(np.int32)), pa.array(marker[first]), *lists], names=["chr", "marker", "codes", "values"])


def bin_genotypes(spark: SparkSession, sf_dir: str, packed: bool = False) -> DataFrame:
    """``BIN_GENO`` over ``OBS`` with one shuffle: lines are dealt by marker, which all sums
    of a line, of a part and of a bin are inside of. ``packed``: a row a marker, (chr, marker,
    codes, values), with suppliers' numbers for names."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_suppkey AS s", "CAST(l_linenumber AS INT) AS chr", "l_partkey AS p", f"CAST((l_partkey + 1) * {SPACING} AS BIGINT) DIV {SPACING * 100} AS bin",
        "CAST(l_quantity AS INT) % 6 AS q", "CASE WHEN CAST(ROUND(l_discount * 100) AS INT) = 10 AND CAST(l_quantity AS INT) % 6 > 0 THEN 1 ELSE 0 END AS e",
    )
    if packed:
        marker = f"chr * 1000000 + CAST((p + 1) * {SPACING} AS BIGINT) DIV {SPACING * 100}"
        narrow = lines.where("chr IS NOT NULL AND p IS NOT NULL").selectExpr("chr", "CAST(s AS BIGINT) AS s", "CAST(p AS BIGINT) AS p", "CAST(2 * COALESCE(q, 0) + e AS TINYINT) AS qe")
        dealt = narrow.repartition(F.expr(marker)).selectExpr(f"{marker} AS marker", "chr", "s", "p", "qe")
        return dealt.sortWithinPartitions("marker").mapInArrow(_marker_vectors, "chr int, marker long, codes array<long>, values array<double>")
    dealt = lines.selectExpr("chr", "chr * 1000000 + bin AS marker", "s", "p", "q", "e").repartition("chr", "marker")
    parts = dealt.groupBy("chr", "marker", "s", "p").agg(F.sum("q").alias("n"), F.sum("e").alias("e"))
    kind = f"(p DIV {BLOCK} + s) % 10"
    alt = parts.selectExpr("chr", "marker", "s", "n", f"CASE WHEN {kind} < 7 THEN least(e, n) WHEN {kind} = 7 THEN n DIV 2 ELSE n - least(e, n) END AS a")
    bins = alt.groupBy("chr", "marker", "s").agg(F.sum(F.expr("CAST(a AS INT)")).alias("a"), F.sum(F.expr("CAST(n - a AS INT) + CAST(a AS INT)")).alias("d"))
    return bins.where("d > 0").selectExpr("chr", "marker", "marker - chr * 1000000 AS bin", "concat('S', CAST(s AS STRING)) AS sample", "CAST((4 * a + d) DIV (2 * d) AS INT) AS dosage")


def duck(text: str, **names: str) -> str:
    return text.format(div="//", pos="INT", **{"lineitem": "lineitem", **names})


OBS_SQL = duck(OBS)
