"""Fast exact byte-level BPE ids over Arrow batches.

Text splits at single spaces and white-space runs exactly where the vocabulary's
own pre-tokenizer must split, so a chunk's ids do not depend on its neighbours.
Before that, a text splits at the vocabulary's added token, wherever it is written.
Ids of a chunk are remembered; chunks that a batch meets for the first time are
encoded in one call."""

from __future__ import annotations

import base64
import re

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: The code points that the pre-tokenizer takes as white space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BLANK = re.compile(rf"[{_SPACE}]")
#: The token that the vocabulary takes out of a text before all else.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: Remembered chunks and characters looked at in one go; both bound a worker's memory.
REMEMBER, AT_ONCE = 400_000, 4_000_000


class Encoder:
    """``encode(texts)`` -> (ids uint16, bounds): ids of all texts, n+1 offsets."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(f"{VOCABULARY}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self._width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self._seen: dict[str, int] = {}
        self._ids, self._start, self._len, self._n = np.zeros(1 << 20, np.uint16), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), 0

    def _store(self, chunks: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        used, k = self._n, len(self._seen)
        while used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while k + len(chunks) > len(self._start):
            self._start, self._len = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._len))
        self._ids[used : used + len(ids)] = ids
        self._len[k : k + len(chunks)] = lens
        self._start[k : k + len(chunks)] = used + np.cumsum(lens) - lens
        self._n = used + len(ids)
        self._seen.update(zip(chunks, range(k, k + len(chunks))))

    def _learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if not _BLANK.match(c[-1])]
        blank = [c for c in chunks if _BLANK.match(c[-1])]
        if plain:
            # a chunk without a leading space follows a line end, whose one-byte token is dropped again
            joined = "".join(c if c[0] == " " else "\n" + c for c in plain)
            ids = np.asarray(self._bpe.encode_ordinary(joined), np.int64)
            ends = np.cumsum([len(c.encode()) + (c[0] != " ") for c in plain])
            cuts = np.searchsorted(np.cumsum(self._width[ids]), ends) + 1
            begins = np.concatenate([[0], cuts[:-1]])
            lead = np.fromiter((c[0] != " " for c in plain), bool, len(plain))
            keep = np.ones(len(ids), bool)
            keep[begins[lead]] = False
            self._store(plain, ids[keep], cuts - begins - lead)
        for c in blank:
            ids = self._bpe.encode_ordinary(c)
            self._store([c], np.asarray(ids, np.uint16), np.asarray([len(ids)]))

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [_CHUNK.findall(t) for t in texts]
        if len(self._seen) > REMEMBER:
            self._forget()
        new = {c for f in found for c in f if c not in self._seen}
        if new:
            self._learn(sorted(new))
        at = np.fromiter((i for f in found for i in map(self._seen.__getitem__, f)), np.int64, sum(map(len, found)))
        lens = self._len[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self._start[at] - (ends - lens), lens)
        per = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        bounds = np.concatenate([[0], ends])[per]
        return self._ids[take], bounds

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any(ADDED in t for t in texts):
            return self._encode(texts)
        pieces = [t.split(ADDED) for t in texts]
        ids, bounds = self._encode([p for some in pieces for p in some])
        last = np.cumsum([len(some) for some in pieces]) - 1
        inner = np.ones(len(bounds) - 1, bool)
        inner[last] = False
        whole = np.insert(ids, bounds[1:][inner], np.uint16(ADDED_ID))
        return whole, np.concatenate([[0], (bounds[1:] + np.cumsum(inner))[last]])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds, now, size = [], [np.zeros(1, np.int64)], [], 0
        done = 0

        def flush() -> None:
            nonlocal now, size, done
            if now:
                a, b = self._some(now)
                ids.append(a)
                bounds.append(b[1:] + done)
                done += len(a)
            now, size = [], 0

        for t in texts:
            if len(t) > AT_ONCE:
                flush()
                n = 0
                for piece in _safe_pieces(t):
                    a, _ = self._some([piece])
                    ids.append(a)
                    n += len(a)
                done += n
                bounds.append(np.asarray([done]))
                continue
            now.append(t)
            size += len(t)
            if size >= AT_ONCE:
                flush()
        flush()
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint16)), np.concatenate(bounds).astype(np.int64)


def _safe_pieces(text: str):
    """Cuts a long text before single spaces between two non-blanks."""
    cut = re.compile(rf"(?<=[^{_SPACE}])(?= [^{_SPACE}])")
    at = 0
    while at < len(text):
        m = cut.search(text, at + AT_ONCE) if at + AT_ONCE < len(text) else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


_shared: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    if path not in _shared:
        _shared[path] = Encoder(path)
    return _shared[path]
