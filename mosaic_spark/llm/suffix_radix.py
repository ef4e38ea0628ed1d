"""Suffix dedup by a depth-limited radix sort.

Suffixes are told apart only to ``DEPTH`` = 100 bytes, by most-significant-digit
passes; suffixes that are equal to that depth are the repeated windows.

Anchors. The first digit is a ``DIGIT``-byte gram. Of the grams inside a window the
one with the smallest hash (the leftmost of equals) is its anchor, so equal windows
have equal anchors at equal places, and about one position in 40 enters the sort.

Copies. Of equal whole texts (by SHA-256) only the first takes part; all windows of the
others start earlier there.

Pass 1 groups anchors by gram, merged map-side. A gram that one text holds once ends
its windows there. The repeated grams go back to the documents: as an array while
there are at most ``FEW`` of them, else by a join, so nothing unbounded is sent out.
Pass 2 sorts the windows around the anchors that are left, by gram and then by a hash
of all their bytes, confirms neighbours of one hash byte by byte to full depth, and keeps
the first of every group of equals. Equal contexts of
a batch are merged before they are shuffled. A gram that more than ``hot_rows``
anchors hold is replaced by the digits of its single windows, so a passage in a
third of all documents is dealt out by content.

A document's bytes go where windows lie that are not the first of their group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_buffers, whole_groups
from .lsh_forest import mixed

DEPTH, DIGIT = 100, 24
#: Entries at most of an array that goes along with tasks.
FEW = 2_000_000
HOT_ROWS = 100_000
#: Bytes looked at in one go; positions inside fit the anchor's packed low bits.
AT_ONCE = 1 << 18
_LOW = np.uint64(AT_ONCE * 2 - 1)
#: Bytes of contexts sorted in one go, and of texts put together: every one costs some 30 bytes meanwhile.
BLOCK_BYTES = 2_000_000
_P = 0x9E3779B97F4A7C15
_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _power or len(_power[base]) < n:
        p = np.full(max(n, AT_ONCE + 2 * DEPTH), base % (1 << 64), np.uint64)
        p[0] = 1
        _power[base] = np.multiply.accumulate(p)
    return _power[base][:n]


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width``-byte gram of ``raw``."""
    n = len(raw)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * _powers(pow(_P, -1, 1 << 64), n - width + 1))


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchor_runs(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of texts in one buffer: arrays (row, first window, last window, anchor, gram
    hash) of runs of windows with one anchor, positions in the buffer."""
    w = DEPTH - DIGIT + 1
    for base in range(0, len(raw), AT_ONCE):
        part = raw[base : base + AT_ONCE + DEPTH - 1]
        windows = len(part) - DEPTH + 1
        if windows <= 0:
            continue
        h = gram_hashes(part, DIGIT)
        least = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), w)[:windows]
        anchor = (least & _LOW).astype(np.int64)
        start = np.arange(windows) + base
        row = np.searchsorted(off, start, "right") - 1
        ok = start + DEPTH <= off[row + 1]
        new = np.ones(windows, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], windows) - 1
        keep = ok[first]
        first, last = first[keep], last[keep]
        yield row[first], first + base, last + base, anchor[first] + base, h[anchor[first]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (tid, text): for every gram of a batch the smallest and largest text it
    is in, and its number. A gram twice in one text counts as in two."""
    for b in batches:
        raw, off = text_buffers(b.column(1))
        tid = b.column(0).to_numpy(zero_copy_only=False)
        for i, j in slices(off, 16_000_000):
            base = off[i]
            found = [(r, a, h) for r, _, _, a, h in anchor_runs(raw[base : off[j]], off[i : j + 1] - base)]
            if not found:
                continue
            row, anchor, h = (np.concatenate(c) for c in zip(*found))
            fresh = np.append(True, anchor[1:] != anchor[:-1])  # a run cut at a chunk's end is one anchor
            row, h = row[fresh], h[fresh].view(np.int64)
            t = tid[i:j][row]
            order = np.lexsort((row, t, h))
            h, t, row = h[order], t[order], row[order]
            twice = np.zeros(len(h), bool)
            twice[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.diff(np.append(start, len(h)))
            lo, hi = t[start], t[start + n - 1]
            hi = np.where(np.logical_or.reduceat(twice, start) & (lo == hi), lo ^ 1, hi)
            yield pa.RecordBatch.from_arrays([pa.array(h[start]), pa.array(np.minimum(lo, hi)), pa.array(np.maximum(lo, hi)), pa.array(n, pa.int64())], names=["h", "lo", "hi", "n"])


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (rid, text): (h, rid), once each."""
    for b in batches:
        raw, off = text_buffers(b.column(1))
        rid = b.column(0).to_numpy(zero_copy_only=False)
        for i, j in slices(off, 16_000_000):
            base = off[i]
            found = [(r, h) for r, _, _, _, h in anchor_runs(raw[base : off[j]], off[i : j + 1] - base)]
            if found:
                row, h = (np.concatenate(c) for c in zip(*found))
                row, h = np.unique(np.stack([row, h.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rid[i:j][row])], names=["h", "rid"])


def _repeated(raw, off, grams: np.ndarray):
    """Anchor runs whose gram is in the sorted array ``grams``."""
    if not len(grams):
        return
    for row, first, last, anchor, h in anchor_runs(raw, off):
        k = h.view(np.int64)
        keep = grams[np.minimum(np.searchsorted(grams, k), len(grams) - 1)] == k
        if keep.any():
            yield row[keep], first[keep], last[keep], anchor[keep], k[keep]


class _Marks:
    """What rows (.., grams, copied) know: which grams repeat and which rows are
    copies of an earlier text; from arrays sent along, or from their own columns."""

    def __init__(self, grams: np.ndarray | None, copied: np.ndarray | None) -> None:
        self.all_grams, self.all_copied = grams, copied

    def grams(self, column: pa.Array, i: int, j: int) -> np.ndarray:
        if self.all_grams is not None:
            return self.all_grams
        return np.unique(column.slice(i, j - i).flatten().to_numpy(zero_copy_only=False))

    def copied(self, rid: np.ndarray, column: pa.Array) -> np.ndarray:
        if self.all_copied is not None:
            return np.isin(rid, self.all_copied)
        return column.to_numpy(zero_copy_only=False).astype(bool)


def _contexts(hot: np.ndarray, marks: _Marks):
    """Of rows (rid, rank, text, grams, copied): (key, lo, ctx, doc_id, rid, pos):
    windows pos.. of document rid start lo, lo-1, .. bytes before the gram of ``key``;
    ctx are their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, doc = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            copied = marks.copied(rid, b.column(4))
            raw_all, off_all = text_buffers(b.column(2))
            for i, j in slices(off_all, 8_000_000):
                raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
                seen: dict[tuple, tuple] = {}
                for row, first, last, anchor, key in _repeated(raw, off, marks.grams(b.column(3), i, j)):
                    own = ~copied[i:j][row]
                    is_hot = np.isin(key, hot)
                    for r, f, t, a, k, split in zip(*(x[own].tolist() for x in (row, first, last, anchor, key, is_hot))):
                        r += i
                        for at, end, kk in ((x, x, None) for x in range(f, t + 1)) if split else ((f, t, k),):
                            ctx = raw[at : end + DEPTH].tobytes()
                            if kk is None:
                                kk = int.from_bytes(hashlib.blake2b(ctx, digest_size=8).digest(), "little", signed=True)
                            got = (doc[r], rid[r], at - off[r - i])
                            old = seen.get((kk, a - at, ctx))
                            if old is None or got < old:
                                seen[kk, a - at, ctx] = got
                    if len(seen) > 100_000:
                        yield _context_rows(seen)
                        seen = {}
                if seen:
                    yield _context_rows(seen)

    return run


def _context_rows(seen: dict) -> pa.RecordBatch:
    key, lo, ctx = zip(*seen)
    doc, rid, pos = zip(*seen.values())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(lo, pa.int32()), pa.array(ctx, pa.binary()), pa.array(doc, pa.int64()), pa.array(rid, pa.int64()), pa.array(pos, pa.int64())], names=["key", "lo", "ctx", "doc_id", "rid", "pos"])


def _confirmed(raw: np.ndarray, at: np.ndarray, content: np.ndarray, order: np.ndarray, group: np.ndarray) -> bool:
    """Whether windows that stand side by side with one hash have the same bytes: compared
    eight at a time, from the first digit to full depth."""
    words = np.ndarray((max(0, len(raw) - 7),), "<u8", np.ascontiguousarray(raw), strides=(1,))
    a, b = order[:-1], order[1:]
    same = np.flatnonzero((content[a] == content[b]) & (group[a] == group[b]))
    for k in range(0, len(same), 1 << 18):
        x, y = at[a[same[k : k + (1 << 18)]]], at[b[same[k : k + (1 << 18)]]]
        for digit in (*range(0, DEPTH - 8, 8), DEPTH - 8):
            if (words[x + digit] != words[y + digit]).any():
                return False
    return True


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole groups of contexts: (rid, pos, bits), bit w set where window pos+w
    is the first of its equals."""
    for whole, bounds in whole_groups(batches):
        many = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        raw_all, off_all = text_buffers(whole.column(2))
        lo_all, doc_all, rid_all, pos_all = (whole.column(c).to_numpy(zero_copy_only=False) for c in (1, 3, 4, 5))
        # groups in blocks; a group is never divided
        size = off_all[bounds]
        g = 0
        while g < len(bounds) - 1:
            e = max(g + 1, int(np.searchsorted(size, size[g] + BLOCK_BYTES, "right")) - 1)
            i, j = bounds[g], bounds[min(e, len(bounds) - 1)]
            g = e
            raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
            n = np.diff(off) - DEPTH + 1
            ends = np.cumsum(n)
            r = np.repeat(np.arange(j - i), n)
            w = np.arange(ends[-1]) - np.repeat(ends - n, n)
            at = off[r] + w
            content = gram_hashes(raw, DEPTH)[at]
            group, doc, rid, pos = many[i:j][r], doc_all[i:j][r], rid_all[i:j][r], pos_all[i:j][r] + w
            order = np.lexsort((pos, rid, doc, lo_all[i:j][r] - w, content, group))
            if not _confirmed(raw, at, content, order, group):
                # two strings share a hash: their bytes name them instead
                rows = np.lib.stride_tricks.sliding_window_view(raw, DEPTH)[at]
                content = np.unique(np.ascontiguousarray(rows).view(f"V{DEPTH}")[:, 0], return_inverse=True)[1].astype(np.uint64)
                order = np.lexsort((pos, rid, doc, lo_all[i:j][r] - w, content, group))
            s = lambda x: x[order]
            new = np.ones(len(order), bool)
            new[1:] = (s(group)[1:] != s(group)[:-1]) | (s(content)[1:] != s(content)[:-1]) | ((lo_all[i:j][r] - w)[order][1:] != (lo_all[i:j][r] - w)[order][:-1])
            first = np.zeros(len(order), bool)
            first[order[new]] = True
            bits = [np.packbits(first[x:y]).tobytes() for x, y in zip(ends - n, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(rid_all[i:j]), pa.array(pos_all[i:j], pa.int64()), pa.array(bits, pa.binary())], names=["rid", "pos", "bits"])


def _removed(batches: Iterator[pa.RecordBatch], marks: _Marks, with_bytes: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (rid, doc_id, text, grams, copied, kept): the result of each."""
    for b in batches:
        rid, doc, kept = b.column(0).to_numpy(zero_copy_only=False), b.column(1), b.column(5)
        copied = marks.copied(rid, b.column(4))
        raw_all, off_all = text_buffers(b.column(2))
        for i, j in slices(off_all, BLOCK_BYTES):
            raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
            delta = np.zeros(len(raw) + 1, np.int32)
            for row, first, last, _, _ in _repeated(raw, off, marks.grams(b.column(3), i, j)):
                base = int(first[0])
                again = np.zeros(int(last[-1]) - base + 1, bool)
                for f, t in zip(first, last):
                    again[f - base : t - base + 1] = True
                for r in np.unique(row).tolist():
                    for span in kept[i + r].as_py() or ():
                        at = int(off[r]) + span["pos"] - base
                        bits = np.flatnonzero(np.unpackbits(np.frombuffer(span["bits"], np.uint8))) + at
                        again[bits[(bits >= 0) & (bits < len(again))]] = False
                starts = np.flatnonzero(again) + base
                np.add.at(delta, starts, 1)
                np.add.at(delta, starts + DEPTH, -1)
            gone = np.cumsum(delta[:-1]) > 0
            rows = []
            for r in range(j - i):
                text, g = raw[off[r] : off[r + 1]], gone[off[r] : off[r + 1]]
                if copied[i + r]:
                    g = np.full(len(text), len(text) >= DEPTH)
                n = int(g.sum())
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
                left = (text[~g] if n else text).tobytes()
                rows.append((len(text), n, spans, hashlib.sha256(left).hexdigest(), left if with_bytes else None))
            cols = [*zip(*rows)]
            yield pa.RecordBatch.from_arrays([doc.slice(i, j - i), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3]), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def _array(df: DataFrame) -> np.ndarray:
    """A bounded column of longs, sorted: eight bytes a row on the driver."""
    return np.sort(df.toArrow().column(0).to_numpy())


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot_rows: int = HOT_ROWS, with_bytes: bool = True, few: int = FEW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes), a row per
    document.

    Every byte goes that lies in a 100-byte string which also starts earlier: in a
    smaller doc_id, or earlier in the document. Strings are judged on the input,
    never across documents. Null text is empty; texts under 100 bytes stay whole.
    A null id ranks last. Rows that repeat both id and text are one document, all
    reported alike; rows of one id with different texts rank by a hash of the text.
    kept_bytes are the bytes that stay (null without ``with_bytes``). An empty table
    gives an empty result."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rank = F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))
    rows = docs.select(F.xxhash64(rank, whole).alias("rid"), F.xxhash64(whole).alias("tid"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("sha"), rank.alias("rank"), F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"))
    grams = rows.select("tid", "text").mapInArrow(_anchors, "h long, lo long, hi long, n long").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    grams = cut(grams.where("lo <> hi").select("h", "n"))
    # fewer than anchors / hot_rows
    hot = _array(grams.where(F.col("n") > hot_rows).select("h"))
    first = rows.groupBy("sha").agg(F.min_by("rid", "rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = cut(rows.select("sha", "rid").join(first, "sha").where("rid <> first").select("rid").distinct())
    work = rows.drop("tid", "sha")
    if grams.count() <= few and copies.count() <= few:
        marks = _Marks(_array(grams.select("h")), _array(copies))
        work = work.withColumns({"grams": F.array().cast("array<long>"), "copied": F.lit(False)})
    else:
        marks = _Marks(None, None)
        own = rows.select("rid", "text").mapInArrow(_grams_of, "h long, rid long").join(grams.select("h"), "h").groupBy("rid").agg(F.collect_list("h").alias("grams"))
        work = work.join(own, "rid", "left").join(copies.withColumn("copied", F.lit(True)), "rid", "left")
        work = work.withColumns({"grams": F.coalesce("grams", F.array().cast("array<long>")), "copied": F.coalesce("copied", F.lit(False))})
    contexts = work.select("rid", "rank", "text", "grams", "copied").mapInArrow(_contexts(hot, marks), "key long, lo int, ctx binary, doc_id long, rid long, pos long")
    firsts = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_firsts, "rid long, pos long, bits binary")
    kept = firsts.groupBy("rid").agg(F.collect_list(F.struct("pos", "bits")).alias("kept"))
    full = work.join(kept, "rid", "left").select("rid", "doc_id", "text", "grams", "copied", "kept")
    return full.mapInArrow(lambda batches: _removed(batches, marks, with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def suffix_report(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs, with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
