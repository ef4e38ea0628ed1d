"""Token counts from an exact length histogram.

Documents are encoded in place and leave the scan as a length; lengths aggregate
map-side to (length, documents). Suffix sums over that histogram, whose rows are
distinct lengths and not documents, answer totals, quantiles and truncated totals
for every context limit at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def encoded_lengths(docs: DataFrame, text: str = "text", vocabulary: str | None = None, *keep: str) -> DataFrame:
    """``keep`` columns and n_tokens of every row; null text has 0 tokens."""
    fields = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc = encoder(vocabulary)
        for b in batches:
            _, bounds = enc.encode(["" if t is None else t for t in b.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.diff(bounds), pa.int64())], names=[*keep, "n_tokens"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join([*fields, "n_tokens long"]))


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, docs): exact histogram of encoded lengths."""
    return encoded_lengths(docs, text, vocabulary).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def length_table(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per distinct length L with docs and tokens of exactly L, of at
    least L (suffix sums), the total when every document is truncated to L, and
    the share of documents of at most L (its quantile).

    Null text counts as empty (length 0). An empty table gives an empty result."""
    h = cut(length_histogram(docs, text, vocabulary)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    # one row per distinct length: bounded by the longest document, not by the corpus
    up = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"docs_at_least": F.sum("docs").over(up), "tokens_at_least": F.sum("tokens").over(up)})
    every = Window.partitionBy()
    h = h.withColumns({"all_docs": F.sum("docs").over(every), "all_tokens": F.sum("tokens").over(every)})
    return h.select(
        "n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("quantile"),
        "all_tokens",
    )


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut to ``limit``, for any limit."""
    n = F.col("n_tokens")
    return table.agg(F.coalesce(F.sum(F.least(n, F.lit(limit)) * F.col("docs")), F.lit(0)).alias("truncated_total"))
