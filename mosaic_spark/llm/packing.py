"""Hierarchical multi-length packing of documents into training sequences.

Every scan partition packs its own stream, so nothing is shuffled and a hot
source or copy group costs no more than its bytes. A document's whole windows
stand alone. Its remainder is routed to the context tier that holds it: 256, 512,
1,024 or 2,048 tokens. Each tier is packed into sequences of its own size, the long
ones first: a sequence opens with the longest piece of its tier and its gap is
filled from the tiers below, longest fit first; where nothing fits, the shortest
longer piece is cut at the gap. What is left when a partition ends becomes sequences
of exact power-of-two length, so nothing is padded.

Sequences of one tier that make up a window's tokens are a row. Rows are dealt to
open step groups of equal tokens so that all groups hold alike many of each tier.

State of a task: one batch of ids and a pool of at most ``pool_tokens``."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
END_ID = 1
#: Rows of LIMIT tokens that a step group holds, and groups that are open at a time.
STEP_WINDOWS, OPEN_STEPS = 8, 8
#: The shortest tier is this part of the longest.
SHORTEST = 8
POOL_TOKENS = 1 << 19
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step long"


def tier_of(length: int, limit: int = LIMIT) -> int:
    """Smallest power of two that holds ``length``, at most ``limit``."""
    return min(limit, 1 << (length - 1).bit_length())


class Steps:
    """Deals rows of ``limit`` tokens to step groups, some of which are open at a time."""

    def __init__(self, first: int, limit: int) -> None:
        self.next, self.limit = first, limit
        self.rows: dict[int, list[int]] = {}  # tier -> [group, tokens left in its open row]
        self._open()

    def _open(self) -> None:
        self.groups = list(range(self.next, self.next + OPEN_STEPS))
        self.next += OPEN_STEPS
        self.room, self.held = dict.fromkeys(self.groups, STEP_WINDOWS), {}

    def of(self, length: int) -> int:
        """The group of the next sequence of ``length`` tokens."""
        row = self.rows.get(length)
        if row is None or not row[1]:
            if not self.groups:
                self._open()
            group = min(self.groups, key=lambda g: (self.held.get((g, length), 0), -self.room[g], g))
            self.held[group, length] = self.held.get((group, length), 0) + 1
            self.room[group] -= 1
            if not self.room[group]:
                self.groups.remove(group)
            row = self.rows[length] = [group, self.limit]
        row[1] -= length
        return row[0]


class Packer:
    """Streams (doc key, ids) in and placed pieces out."""

    def __init__(self, first_sequence: int, limit: int = LIMIT, pool_tokens: int = POOL_TOKENS) -> None:
        self.limit, self.pool_tokens = limit, pool_tokens
        self.sequence, self.steps = first_sequence, Steps(first_sequence, limit)
        self.held: dict[int, list] = {1 << i: [] for i in range(limit.bit_length())}
        self.tiers = [t for t in self.held if t >= max(1, limit // SHORTEST)][::-1]
        self.pooled, self.ties, self.out = 0, 0, []

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.limit * self.limit
        for at in range(0, whole, self.limit):
            self._emit([(doc, at, ids[at : at + self.limit], len(ids))])
        if whole < len(ids):
            self._pool((doc, whole, ids[whole:].copy(), len(ids)))
        if self.pooled >= self.pool_tokens:
            self._pack(self.pool_tokens // 4)

    def finish(self) -> None:
        """Packs all that is left; the tail becomes exact power-of-two sequences."""
        self._pack(0)
        while self.pooled:
            self._fill(1 << (self.pooled.bit_length() - 1))

    def _pool(self, piece) -> None:
        # length, then arrival, orders a list: no comparison reaches the arrays
        self.ties += 1
        insort(self.held[tier_of(len(piece[2]), self.limit)], (len(piece[2]), self.ties, piece))
        self.pooled += len(piece[2])

    def _pack(self, keep: int) -> None:
        """Packs the tiers, longest first, while more than ``keep`` tokens wait."""
        for tier in self.tiers:
            while self.held[tier] and self.pooled > keep and self.pooled >= tier:
                n, _, piece = self.held[tier].pop()
                self.pooled -= n
                self._fill(tier, piece)

    def _take(self, most: int):
        """The longest pooled piece of at most ``most`` tokens, else the shortest longer one cut there."""
        size = tier_of(most, self.limit)
        while size:
            held = self.held[size]
            if at := bisect_right(held, (most, self.ties + 1)):
                n, _, piece = held.pop(at - 1)
                self.pooled -= n
                return piece
            size >>= 1
        size = tier_of(most, self.limit)
        while not self.held[size] or self.held[size][-1][0] <= most:
            size <<= 1
        held = self.held[size]
        n, _, (doc, start, ids, total) = held.pop(bisect_right(held, (most, self.ties + 1)))
        self.pooled -= n
        self._pool((doc, start + most, ids[most:], total))
        return doc, start, ids[:most], total

    def _fill(self, length: int, first=None) -> None:
        pieces = [first] if first else []
        left = length - sum(len(p[2]) for p in pieces)
        while left:
            piece = self._take(left)
            pieces.append(piece)
            left -= len(piece[2])
        self._emit(pieces)

    def _emit(self, pieces) -> None:
        length = sum(len(p[2]) for p in pieces)
        step, at = self.steps.of(length), 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, at, length, step))
            at += len(ids)
        self.sequence += 1


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, limit: int = LIMIT, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (tokens of its sequence) and step (step group).

    Null and empty texts are the end id alone. A document longer than ``limit``
    spans several sequences. Rows that repeat an id, or have none, are packed each; other
    columns of ``docs`` are not read, whatever their names. ids and the
    cuts of one partition depend on its rows alone, so a lost task repeats its
    output. An empty table gives an empty result."""
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        enc, packer = encoder(vocabulary), Packer(TaskContext.get().partitionId() << 33, limit, pool_tokens)
        types, names = [pa.int64()] * 9, [f.split()[0] for f in SCHEMA.split(", ")]

        def placed() -> Iterator[pa.RecordBatch]:
            if packer.out:
                rows, packer.out = packer.out, []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.slice(i, 1000)
                ids, bounds = enc.encode(["" if t is None else t for t in part.column(1).to_pylist()])
                for k, doc in enumerate(part.column(0).to_pylist()):
                    packer.add(doc, np.append(ids[bounds[k] : bounds[k + 1]], np.uint16(END_ID)))
                yield from placed()
        packer.finish()
        yield from placed()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
