"""Exact dedup with an extendible-hash index, in DataFrame operators only.

Build: every text is normalised and hashed to a 64-bit pseudo-key. Entries with
one pseudo-key form a chain; inside the chain whole normalised byte strings are
compared (they are grouping keys), so a hash collision cannot merge two texts.
Aggregation runs map-side first, so a text that a third of all rows repeat
arrives at its owner as one row per map task.

Directory: the index starts as one bucket; while a bucket holds more entries than
``bucket_entries`` the directory doubles and that bucket alone splits on its next
key bit. It works on counts of a cell grid of at most 2**MAX_DEPTH rows. The index is
a table of files on the shared folder, dealt by bucket and sorted by key, so that a
bucket's key range has one owner.

Probe: the directory sends rows to their bucket; inside, they find their chain
entry by key and digest. Rows are narrow there, and a hot text's rows are dealt
anew by the skew join of the adaptive planner.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, shared_dir

#: Directory cells never exceed 2**MAX_DEPTH, the proven bound of what the driver reads.
MAX_DEPTH = 16
#: Entries that a bucket holds before it splits.
BUCKET_ENTRIES = 50_000


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` with __id, __cp, __raw (hash of the original text), __norm and __key."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    norm = F.regexp_replace(whole, SPACE + "+", "")
    rows = docs.withColumns({"__id": F.col(doc_id).cast("long"), "__cp": F.char_length(whole), "__raw": F.xxhash64(whole), "__norm": norm})
    return rows.withColumn("__key", F.xxhash64("__norm"))


def cell(depth: int = MAX_DEPTH):
    return F.shiftrightunsigned("__key", 64 - depth) if depth else F.lit(0).cast("long")


def double_directory(cells: list[tuple[int, int]], bucket_entries: int, depth: int = 0) -> list[tuple[int, int]]:
    """Directory as (first cell, local depth) of every bucket, by splitting.

    ``cells``: (cell at MAX_DEPTH bits, entries). A bucket is a run of cells with
    a common prefix; an overfull one splits on its next bit, which doubles the
    directory where its local depth is the global depth."""
    entries = [0] * (1 << MAX_DEPTH)
    for at, n in cells:
        entries[at] += n
    below = [0]
    for n in entries:
        below.append(below[-1] + n)
    done, todo = [], [(p << (MAX_DEPTH - depth), depth) for p in range(1 << depth)]
    while todo:
        first, local = todo.pop()
        width = 1 << (MAX_DEPTH - local)
        if below[first + width] - below[first] > bucket_entries and local < MAX_DEPTH:
            todo += [(first, local + 1), (first + width // 2, local + 1)]
        else:
            done.append((first, local))
    return sorted(done)


class Index:
    """The directory (slot -> bucket) and the folder of the entries."""

    def __init__(self, entries: DataFrame, directory: list[tuple[int, int]], path: str) -> None:
        spark = entries.sparkSession
        self.depth, self.path = max(local for _, local in directory), path
        # of at most 2**MAX_DEPTH rows; slots of the deepest buckets are single
        slots = [0] * (1 << self.depth)
        for bucket, (first, local) in enumerate(directory):
            at, width = first >> (MAX_DEPTH - self.depth), 1 << (self.depth - local)
            slots[at : at + width] = [bucket] * width
        self._slots = spark.createDataFrame(list(enumerate(slots)), "__slot long, __bucket long")
        owned = self.bucketed(entries).repartition("__bucket").sortWithinPartitions("__bucket", "__key")
        owned.write.parquet(path)
        self.entries = spark.read.parquet(path)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket that the directory has for their key."""
        return rows.withColumn("__slot", cell(self.depth)).join(F.broadcast(self._slots), "__slot").drop("__slot")


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_entries: int = BUCKET_ENTRIES) -> Index:
    """Entries (__bucket, __key, __sha, __keep, __keep_cp, __keep_raw, __n), one of every
    distinct normalised text: the row that stays, by id, code points and hash of its
    original text, and the group's size."""
    # a decimal of fixed width keeps the aggregate in hash mode: longest first, then smallest id
    span = F.lit(str(2**64)).cast("decimal(20,0)")
    rank = (F.col("__cp").cast("decimal(18,0)") * span).cast("decimal(38,0)") - F.coalesce("__id", F.lit(2**63 - 1)).cast("decimal(20,0)")
    rows = _keyed(docs, text, doc_id).select("__id", "__cp", "__raw", "__norm", "__key", rank.cast("decimal(38,0)").alias("__rank"))
    top = [F.max_by(f"__{c}", "__rank").alias(f"__keep{n}") for c, n in (("id", ""), ("cp", "_cp"), ("raw", "_raw"))]
    chains = rows.groupBy("__key", "__norm").agg(*top, F.count(F.lit(1)).alias("__n"))
    base, spark = f"{shared_dir(docs.sparkSession)}/exact-index-{uuid.uuid4().hex}", docs.sparkSession
    chains.select("__key", F.sha2(F.col("__norm").cast("binary"), 256).alias("__sha"), "__keep", "__keep_cp", "__keep_raw", "__n").write.parquet(f"{base}/chains")
    entries = spark.read.parquet(f"{base}/chains")
    cells = entries.groupBy(cell().alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    return Index(entries, double_directory([(r.cell, r.n) for r in cells], bucket_entries), f"{base}/buckets")


def _stays(first: str = "__keep"):
    """Is the row the one that its entry names?"""
    return F.col("__id").eqNullSafe(F.col(first)) & (F.col("__cp") == F.col("__keep_cp")) & (F.col("__raw") == F.col("__keep_raw"))


def _repeats(docs: DataFrame, doc_id: str) -> bool:
    """Whether any id is there twice; reads the id column alone."""
    return bool(docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 added.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``.
    Of equal texts the row with most code points, then the smallest id, stays: one row,
    also where rows repeat an id or are alike in all. Null text counts as empty and
    empty texts are equal to each other; a null id ranks last. Input columns keep their
    names; a clashing one is replaced. An empty table gives an empty result."""
    index = build_index(docs, text, doc_id, bucket_entries)
    rows = docs.drop(*[c for c in ("keep_id", "group_size", "kept", "text_sha256") if c not in (text, doc_id)])
    rows = _keyed(rows, text, doc_id).withColumn("__sha", F.sha2(F.col("__norm").cast("binary"), 256)).drop("__norm")
    out = index.bucketed(rows).join(index.entries, ["__bucket", "__key", "__sha"]).withColumn("__stays", _stays())
    if _repeats(docs, doc_id):
        # rows that are alike in id and text: numbered once, the first of them stays
        out = cut(out.withColumn("__row", F.monotonically_increasing_id()))
        first = out.where("__stays").groupBy("__key", "__sha").agg(F.min("__row").alias("__first"))
        out = out.join(first, ["__key", "__sha"]).withColumn("__stays", F.col("__row") == F.col("__first"))
    out = out.withColumns({"keep_id": F.col("__keep"), "group_size": F.col("__n"), "kept": F.col("__stays"), "text_sha256": F.col("__sha")})
    return out.select(*rows.drop("__id", "__cp", "__raw", "__key", "__sha").columns, "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Only the rows that stay, with the columns of ``docs``. Rows meet the index's
    entries by id and text, so that a hot text's rows spread over its ids."""
    keep = build_index(docs, text, doc_id).entries.select(F.col("__key").alias("__k"), "__keep", "__keep_cp", "__keep_raw")
    rows = _keyed(docs, text, doc_id).drop("__norm")
    rows = rows.join(keep, (F.col("__key") == F.col("__k")) & _stays(), "left_semi")
    if _repeats(docs, doc_id):
        rows = rows.dropDuplicates(["__id", "__key", "__raw"])
    return rows.select(*docs.columns)
