"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]. The schedule is
integrated in closed form to cumulative token demand, a document's place in its
source's (hash-shuffled) order is a cumulative token supply, and inverting the
demand at that supply is the document's training position. A final range sort by
position lays the corpus out in training order.

No source is gathered in one task: the order inside a source is cut into
``ORDER_CELLS`` hash cells, cell totals are summed up once, and only rows of one
cell of one source meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

ORDER_CELLS = 4096
#: Weights dealt to sources in code-point order, nulls last.
WEIGHTS = (3, 1, 2)
#: Slope of the schedules, dealt likewise: w(t) = w * (1 + slope * (2t - 1)); mean w.
SLOPES = (-0.5, 0.0, 0.5)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _dealt(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, share_x2: int = 3, most: int = 2) -> DataFrame:
    """(source, source_size, weight, slope, target) from rows (source, size).

    The demand of share_x2/2 of all words is shared by weight, but no source gets
    over ``most`` times its size: with sources by size per weight, the level that
    the first k capped sources leave is a prefix-sum formula. The windows run over
    one row per source, not over documents."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by = by.withColumn("at", F.row_number().over(order) - 1).withColumn("weight", _dealt(weights, F.col("at")).cast("long")).withColumn("slope", _dealt(SLOPES, F.col("at")))
    fill = Window.orderBy((F.col("source_size") * most) / F.col("weight"), "at")
    before, all_of = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    by = by.withColumns({"left2": share_x2 * F.sum("source_size").over(all_of) - 2 * capped, "w_left": F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    fits = F.col("left2") <= 2 * most * F.col("source_size") * F.col("w_left") / F.col("weight")
    by = by.withColumn("first", F.min(F.when(fits, F.struct(F.col("source_size") * most / F.col("weight"), "at", "left2", "w_left"))).over(all_of))
    level = F.col("weight") * F.col("first.left2") / (2 * F.col("first.w_left"))
    return by.select("source", "source_size", "weight", "slope", F.least(level, (F.col("source_size") * most).cast("double")).alias("target"))


def curriculum(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = "mix-1", weights=WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, position), a row
    per document.

    position is the training time in [0, 1] of the first copy, null where the mix
    takes none. Order inside a source follows md5(id, seed), so reruns agree.
    Null text has size 0 and is never taken; null sources are one source, dealt
    last; rows that repeat an id are taken alike in turn. An empty table gives an
    empty result."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(seed)).cast("binary")).alias("key"))
    rows = cut(rows.withColumn("cell", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))
    goal = targets(rows, weights)
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("n"))
    prefix = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("n").over(prefix), F.lit(0))).drop("n")
    plan = cells.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select(F.col("c.source").alias("__source"), F.col("c.cell").alias("__cell"), "base", "source_size", "slope", "target")
    # at most ORDER_CELLS rows a source; joined by source and cell, so a hot source is spread
    full = rows.join(plan, F.col("source").eqNullSafe(F.col("__source")) & (F.col("cell") == F.col("__cell")))
    inside = Window.partitionBy("__source", "__cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("rounds") * F.col("source_size")
    copies = F.when(F.col("size") > 0, F.col("rounds") + (F.col("start") < rest).cast("long")).otherwise(0)
    full = full.withColumn("rounds", rounds.cast("long")).withColumn("copies", copies.cast("long"))
    # demand D(t) = target * (t + slope * (t*t - t)); its inverse at the supply before the document
    return full.withColumn("taken", F.col("copies") * F.col("size")).withColumn("position", F.when(F.col("copies") > 0, invert(F.col("start"), F.col("target"), F.col("slope")))).select("doc_id", "source", "size", "source_size", "target", "slope", "copies", "taken", "start", "position")


def invert(supply: Column, target: Column, slope: Column) -> Column:
    """t with target * ((1 - slope) * t + slope * t * t) = supply, in [0, 1]."""
    u, b = F.least(supply / target, F.lit(1.0)), 1 - slope
    root = 2 * u / (b + F.sqrt(F.greatest(b * b + 4 * slope * u, F.lit(0.0))))
    return F.when(target > 0, root)


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = "mix-1") -> DataFrame:
    """The mixed corpus: every copy that the curriculum takes, with the columns of
    ``docs``, range-sorted by training position. Rows that repeat an id are each
    taken as often as that id's row in the curriculum."""
    plan = curriculum(docs, text, doc_id, source, seed)
    picks = plan.where("copies > 0").groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"), F.min("start").alias("__start"), F.max("source_size").alias("__size"), F.max("target").alias("__target"), F.max("slope").alias("__slope"))
    out = docs.join(picks, F.col(doc_id).eqNullSafe(F.col("__id"))).withColumn("__k", F.explode(F.sequence(F.lit(0), (F.col("__copies") - 1).cast("int"))))
    out = out.withColumn("__t", invert(F.col("__start") + F.col("__k") * F.col("__size"), F.col("__target"), F.col("__slope")))
    return out.repartitionByRange("__t", doc_id).sortWithinPartitions("__t", doc_id).select(*docs.columns)


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: what the mix takes of it, sorted by training position."""
    return curriculum(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "position").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
