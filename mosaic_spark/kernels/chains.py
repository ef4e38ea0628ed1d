"""Maximum-probability paths of many chains at once.

A chain is a run of rows; chains of similar length are padded into one array and
every step works on all of them. Works on int64 (fixed point) and on float64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def batches_of(bounds: np.ndarray, cells: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(chain numbers, lengths) by similar length, longest first, each group padded to
    at most twice its cells."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    i = 0
    while i < len(order):
        longest = length[order[i]]
        j = i + int(np.searchsorted(-length[order[i:]], -(longest // 2), "right"))
        j = min(max(j, i + 1), i + max(1, cells // longest))
        yield order[i:j], length[order[i:j]]
        i = j


def padded(values: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """[step, chain, ...] of rows; beyond a chain's end its last row repeats."""
    at = starts[None, :] + np.minimum(np.arange(length[0])[:, None], length[None, :] - 1)
    return values[at]


def _choose(candidates: list[np.ndarray], last_ties: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best of candidates in predecessor order and its number."""
    best, arg = candidates[0], np.zeros(candidates[0].shape, np.uint8)
    for k, c in enumerate(candidates[1:], 1):
        better = c >= best if last_ties else c > best
        best = np.where(better, c, best)
        arg[better] = k
    return best, arg


def viterbi(start: np.ndarray, step, emission: np.ndarray, length: np.ndarray, last_ties: bool = False) -> np.ndarray:
    """[step, chain] states. emission is [step, chain, state]; ``step`` is a matrix
    [from, to], or a function of the step number giving [from, to, chain]. On equal
    scores the first predecessor wins, or the last; the final state is the first."""
    steps, chains, states = emission.shape
    score = (start[:, None] + emission[0].T).astype(emission.dtype)
    back = np.zeros((steps, states, chains), np.uint8)
    for t in range(1, steps):
        live = int(np.searchsorted(-length, -t, "left"))
        move = step(t)[:, :, :live] if callable(step) else step[:, :, None]
        s, arg = score[:, :live], back[t, :, :live]
        best = s[0] + move[0]
        for j in range(1, states):
            other = s[j] + move[j]
            better = other >= best if last_ties else other > best
            np.copyto(best, other, where=better)
            np.copyto(arg, np.uint8(j), where=better)
        score[:, :live] = best + emission[t, :live].T
    path = np.zeros((steps, chains), np.int8)
    at = score.argmax(axis=0)
    for t in range(steps - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, "left"))
        path[t, :live] = at[:live]
        if t:
            at[:live] = back[t, at[:live], np.arange(live)]
    return path


def rigid_viterbi(start: np.ndarray, step: np.ndarray, emission: np.ndarray, length: np.ndarray, rigid: int, last_ties: bool = False, impossible: int = -(10**15)) -> np.ndarray:
    """Like ``viterbi`` with a minimum run of ``rigid`` steps in a state.

    Each state is a corridor of ``rigid`` places: the first is entered from another
    state's last place, the others follow on, the last may stay. Only these moves
    exist, so a step costs 3 * rigid, not its square."""
    if rigid == 1:
        return viterbi(start, step, emission, length, last_ties)
    steps, chains, states = emission.shape
    score = np.full((states, rigid, chains), impossible, emission.dtype)
    score[:, 0] = start[:, None]
    score += emission[0].T[:, None, :]
    entered = np.zeros((steps, states, chains), np.uint8)
    stayed = np.zeros((steps, states, chains), bool)
    others = [[j for j in range(states) if j != k] for k in range(states)]
    for t in range(1, steps):
        live = int(np.searchsorted(-length, -t, "left"))
        s = score[:, :, :live]
        new = np.empty_like(s)
        new[:, 1 : rigid - 1] = s[:, : rigid - 2]
        for k in range(states):
            new[k, 0], arg = _choose([s[j, -1] + step[j, k] for j in others[k]], last_ties)
            entered[t, k, :live] = np.array(others[k], np.uint8)[arg]
            new[k, -1], arg = _choose([s[k, -2], s[k, -1] + step[k, k]], last_ties)
            stayed[t, k, :live] = arg.astype(bool)
        new += emission[t, :live].T[:, None, :]
        score[:, :, :live] = np.maximum(new, impossible * 1000)
    path = np.zeros((steps, chains), np.int8)
    flat = score.reshape(states * rigid, chains).argmax(axis=0)
    state, place = flat // rigid, flat % rigid
    for t in range(steps - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, "left"))
        path[t, :live] = state[:live]
        if t:
            m, p, i = state[:live], place[:live], np.arange(live)
            enter, stay = p == 0, (p == rigid - 1) & stayed[t, m, i]
            state[:live] = np.where(enter, entered[t, m, i], m)
            place[:live] = np.where(enter, rigid - 1, np.where(stay, p, p - 1))
    return path


def posteriors(start: np.ndarray, step: np.ndarray, emission: np.ndarray, length: np.ndarray) -> np.ndarray:
    """[step, chain, state] forward-backward posteriors; probabilities in, logs of
    emissions in, each step rescaled."""
    steps, chains, states = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    inside = np.arange(steps)[:, None] < length[None, :]
    fwd, bwd = np.zeros_like(e), np.ones_like(e)
    f = start[None, :] * e[0]
    fwd[0] = f / f.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        f = (fwd[t - 1] @ step) * e[t]
        fwd[t] = f / np.maximum(f.sum(axis=1, keepdims=True), 1e-300)
    for t in range(steps - 2, -1, -1):
        b = (bwd[t + 1] * e[t + 1]) @ step.T
        b /= np.maximum(b.sum(axis=1, keepdims=True), 1e-300)
        bwd[t] = np.where(inside[t + 1][:, None], b, 1.0)
    g = fwd * bwd
    return g / np.maximum(g.sum(axis=2, keepdims=True), 1e-300)


def decode_rows(bounds: np.ndarray, logs: np.ndarray, decode, extra: np.ndarray | None = None) -> np.ndarray:
    """State of every row: ``decode(emission, length[, extra])`` over padded groups."""
    out = np.zeros(len(logs), np.int32)
    for chains, length in batches_of(bounds):
        starts = bounds[:-1][chains]
        args = [padded(logs, starts, length), length]
        if extra is not None:
            args.append(padded(extra, starts, length))
        path = decode(*args)
        inside = np.arange(length[0])[:, None] < length[None, :]
        out[(starts[None, :] + np.arange(length[0])[:, None])[inside]] = path[inside]
    return out
