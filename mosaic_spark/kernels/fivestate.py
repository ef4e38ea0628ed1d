"""Imputation of recoded family genotypes by a five-state chain, trained by Viterbi.

States are A, three shades of heterozygous, C. Only called sites of a taxon form its
chain; moves depend on the distance between them."""

from __future__ import annotations

import numpy as np

from .chains import batches_of, padded, viterbi
from .haplotypes import MISSING, _sorted

#: Starting P(call | state) and moves per average segment.
EMISSION = np.array([[0.998, 0.001, 0.001], [0.6, 0.2, 0.2], [0.4, 0.2, 0.4], [0.2, 0.2, 0.6], [0.001, 0.001, 0.998]])
MOVES = np.array([
    [0.999, 0.0001, 0.0003, 0.0001, 0.0005], [0.0002, 0.999, 0.00005, 0.00005, 0.0002], [0.0002, 0.00005, 0.999, 0.00005, 0.0002],
    [0.0002, 0.00005, 0.00005, 0.999, 0.0002], [0.0005, 0.0001, 0.0003, 0.0001, 0.999],
])
GENOTYPE = np.array([0, 1, 1, 1, 2])


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(x, 0))


def scaled_moves(moves: np.ndarray, gap: np.ndarray, segment: float) -> np.ndarray:
    """Log moves [step, from, to, chain] over the gaps [step, chain]: the rate of a move
    per average segment grows with distance as map distance does."""
    off = ~np.eye(5, dtype=bool)[:, :, None]
    rate = -np.log(1 - 2 * np.clip(moves, 0, 0.4999)) / 2 / segment
    p = (1 - np.exp(-2 * rate[None, :, :, None] * gap[:, None, None, :])) / 2 * off
    return _log(np.where(off, p, 1 - p.sum(axis=2, keepdims=True)))


def impute(g: np.ndarray, pos: np.ndarray, p_het: float, rounds: int = 50) -> tuple[np.ndarray, int]:
    """(imputed genotypes, rounds used); sites without a call stay missing."""
    _sorted(pos, g.shape[1])
    taxa, sites = g.shape
    called = g != MISSING
    at = np.nonzero(called)
    calls, where = g[at], pos[at[1]].astype(float)
    bounds = np.concatenate([[0], np.cumsum(called.sum(axis=1))])
    length = float(pos[-1] - pos[0]) if sites > 1 else 1.0
    length = length if length > 0 else 1.0
    moves, emission, segment = MOVES, EMISSION, length / max(sites, 1)
    hom = (1 - p_het) / 2
    start = _log(np.array([hom, p_het / 4, p_het / 2, p_het / 4, hom]))
    inner = np.ones(len(calls), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    states, seen, used = np.zeros(len(calls), np.int64), None, 0
    for used in range(1, rounds + 1):
        logs = _log(emission).T[calls]
        for chains, size in batches_of(bounds, 200_000):  # 25 moves a cell
            starts = bounds[:-1][chains]
            x = padded(where, starts, size)
            step = scaled_moves(moves, np.abs(np.diff(x, axis=0)), segment)
            found = viterbi(start, lambda t, step=step: step[t - 1], padded(logs, starts, size), size)
            inside = np.arange(size[0])[:, None] < size[None, :]
            states[(starts[None, :] + np.arange(size[0])[:, None])[inside]] = found[inside]
        shown = np.bincount(states * 3 + calls, minlength=15).reshape(5, 3)
        pair = np.flatnonzero(inner)
        moved = np.bincount(states[pair - 1] * 5 + states[pair], minlength=25).reshape(5, 5)
        settled = seen is not None and (shown == seen).all()
        seen = shown
        if moved.sum():
            segment = length * taxa / moved.sum()
        n = moved.sum(axis=1, keepdims=True)
        moves = np.where(n > 0, moved / np.maximum(n, 1), moves)
        n = shown.sum(axis=1, keepdims=True)
        emission = np.where(n > 0, shown / np.maximum(n, 1), emission)
        if settled:
            break
    out = np.full(g.shape, MISSING)
    out[at] = GENOTYPE[states]
    return out, used
