"""Shared helpers of the corpus operators: shared-folder materialisation,
connected components, and zero-copy access to Arrow text columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session decides; a folder of this machine
    is set only where the session names none and runs on this machine alone."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mosaic-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Intermediate tables of one run, below a folder of its own on the shared folder.

    A table's lineage is cut by its files, so a lost executor costs no earlier step;
    small files are read many to a task. What later steps do not read is deleted."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def put(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.path}/{self._count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more, and lets the executors delete the
        shuffle files of what was read from them."""
        for t in tables:
            delete(self.spark, {f.rsplit("/", 1)[0] for f in t.inputFiles()})
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, paths) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text or binary Arrow column and its n+1 offsets, without
    decoding. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``most_bytes`` each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class DisjointSets:
    """Union-find over arbitrary int ids whose root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = DisjointSets()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.join(a, b)
    ids = [x for x in sets.parent if sets.find(x) != x]
    for i in range(0, len(ids), 100_000):
        part = ids[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([sets.find(x) for x in part], pa.int64())], ["id", "root"])


def _agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, root) sorted by both: (id, its smallest root, false), and (root, smallest
    root, true) for every other root of the id."""
    last = None
    for b in batches:
        if not len(b):
            continue
        ids, roots = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        first = np.append(last is None or ids[0] != last[0], ids[1:] != ids[:-1])
        at = np.maximum.accumulate(np.where(first, np.arange(len(ids)), -1))
        least = np.where(at >= 0, roots[at], last[1] if last else 0)
        last = int(ids[-1]), int(least[-1])
        other = ~first & (roots != least)
        keep = first | other
        yield pa.RecordBatch.from_arrays([pa.array(np.where(first, ids, roots)[keep]), pa.array(least[keep]), pa.array(other[keep])], ["id", "root", "clash"])


#: Edges that one task joins at a time: some 50 MB of its memory.
TASK_EDGES = 250_000


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of an undirected edge table; component is the
    smallest id reachable.

    Each round contracts the edges of a partition to stars, keeps the smallest root of
    every id, turns its other roots into new edges and jumps pointers, until no root
    moves or one partition holds all edges. An id has a row a partition at most, so a
    hot one is no hot key. Nothing is gathered on the driver but a count and marks a
    round; ids without an edge do not appear."""
    tables = Tables(edges.sparkSession, "components")
    now = tables.put(edges.select(F.col(a).cast("long").alias("id"), F.col(b).cast("long").alias("root")).where("id <> root"))
    held, rows = [now], now.count()
    for _ in range(max_rounds):
        parts = -(-rows // TASK_EDGES)
        stars = now.coalesce(max(1, parts)).mapInArrow(_stars, "id long, root long")
        if parts > 1:
            stars = stars.repartition("id").sortWithinPartitions("id", "root")
            agreed = tables.put(stars.mapInArrow(_agreed, "id long, root long, clash boolean"))
            forest, clash = agreed.where("NOT clash").select("id", "root"), agreed.where("clash").select("id", "root")
            up = forest.select(F.col("id").alias("root"), F.col("root").alias("upper"))
            jumped = tables.put(forest.join(up, "root", "left").select("id", F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved")))
            moved, rows = jumped.agg(F.max("moved"), F.count(F.lit(1))).first()
            more = clash.count()
            held += [agreed, jumped]
            now, rows = jumped.select("id", "root").unionByName(clash), rows + more
            if moved or more:
                continue
            stars = jumped.select("id", "root")
        out = tables.put(stars)
        roots = out.select(F.col("root").alias("id")).distinct()
        out = out.select("id", F.col("root").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
        tables.drop(*held)
        return out
    raise RuntimeError("components did not settle")


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of rows that come sorted by a long column: batches that hold whole key
    groups, and the bounds of the groups in each."""
    carry: list[pa.RecordBatch] = []

    def bounds(batch: pa.RecordBatch) -> np.ndarray:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for b in batches:
        if not len(b):
            continue
        at = bounds(b)
        if len(at) > 2 or (carry and carry[-1].column(key)[-1] != b.column(key)[0]):
            head = int(at[-2])
            whole = [*carry, *([b.slice(0, head)] if head else [])]
            carry = []
            if whole:
                whole = joined(whole)
                yield whole, bounds(whole)
            b = b.slice(head)
        carry.append(b)
    if carry:
        whole = joined(carry)
        yield whole, bounds(whole)
