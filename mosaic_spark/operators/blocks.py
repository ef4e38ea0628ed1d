"""Clustering rows into whole chains and running numpy kernels over them.

A chain is one sample's markers on one chromosome in order. Rows are dealt by a
hash of their unit (chain, sample, or family and chromosome) and sorted inside the
partition; Arrow batches are regrouped so that a kernel sees whole units, many at a
time. A task holds a few million cells whatever the cohort's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1_000_000
#: Columns of base pairs: 64 bits inside kernels, whatever the input has.
POSITIONS = ("pos", "start_bp", "end_bp")


def unit_bounds(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Bounds of runs of equal keys."""
    n = len(batch)
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        c = batch.column(batch.schema.get_field_index(k))
        change = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True) if c.null_count else pc.not_equal(c.slice(1), c.slice(0, n - 1))
        if c.null_count:
            both = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, n - 1)))
            change = pc.and_(change, pc.invert(both))
        new[1:] |= change.to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), n)


def whole_units(batches: Iterator[pa.RecordBatch], keys: list[str], cells: int = CELLS) -> Iterator[pa.RecordBatch]:
    """Batches of about ``cells`` rows that never divide a unit. A long unit is joined
    once, at its end."""
    held: list[pa.RecordBatch] = []  # whole units, then the open one
    rows = 0

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for b in batches:
        if not len(b):
            continue
        if held and rows >= cells:
            # does the unit that is open go on in this batch, and does it end there?
            edge = pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1), b]).combine_chunks().to_batches()[0]
            end = int(unit_bounds(edge, keys)[1]) - 1
            if end < len(b):
                yield joined([*held, *([b.slice(0, end)] if end else [])])
                held, rows, b = [], 0, b.slice(end)
        held.append(b)
        rows += len(b)
    if held:
        yield joined(held)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def by_unit(df: DataFrame, keys: list[str], order: list[str], columns: list[str], kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, partitions: int | None = None) -> DataFrame:
    """Runs ``kernel`` over batches of whole units, sorted by keys and ``order``."""
    wide = lambda c: F.col(c).cast("long").alias(c) if c in POSITIONS else F.col(c)
    rows = df.select(*[wide(c) for c in dict.fromkeys([*keys, *order, *columns])]).withColumn("__unit", F.xxhash64(*keys))
    rows = rows.repartition(partitions, "__unit") if partitions else rows.repartition("__unit")
    rows = rows.sortWithinPartitions("__unit", *keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_units(batches, keys):
            out = kernel(whole)
            if out is not None and len(out):
                yield out

    return rows.mapInArrow(run, schema)


def append(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays([*cols, *new.values()], names=[*keep, *new])


def runs(batch: pa.RecordBatch, keys: list[str], state: np.ndarray, source: str) -> pa.RecordBatch:
    """Segments of decoded rows: runs of one state inside a unit."""
    n = len(batch)
    first = np.zeros(n, bool)
    first[unit_bounds(batch, keys)[:-1]] = True
    first[1:] |= state[1:] != state[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], n) - 1
    take = lambda c, i: batch.column(batch.schema.get_field_index(c)).take(pa.array(i))
    return pa.RecordBatch.from_arrays(
        [pa.array([source] * len(at), pa.string()), take("donor", at), take("name", at), take("chr", at), take("pos", at), take("pos", last), pa.array(state[at], pa.int32())],
        names=["source", "donor", "name", "chr", "start_bp", "end_bp", "state"],
    )
