"""Loopy belief propagation over a family: pedigree links times genome positions.

Every taxon is a chain over positions; parents and children exchange messages per
position. A chain's belief is a forward-backward pass tilted by its messages. Taxa of
one depth do not hear each other within a sweep, so their chains are passed together."""

from __future__ import annotations

import math

import numpy as np

FLOOR = 1e-12
#: P(child | parent) of one selfing, used in both directions.
SELFED = np.array([[1.0, 0.0, 0.0], [0.25, 0.5, 0.25], [0.0, 0.0, 1.0]])


def normalised(x: np.ndarray) -> np.ndarray:
    s = x.sum(axis=-1, keepdims=True)
    return np.where(s > 0, x / np.where(s > 0, s, 1), 1 / x.shape[-1])


def interval_rates(pos: np.ndarray, cm: np.ndarray | None = None, rate: float = 0.01) -> np.ndarray:
    """Recombination between neighbours: Haldane on map distance where there is one,
    else ``rate`` per base pair, at most one half."""
    out = np.minimum(0.5, rate * np.maximum(0.0, np.diff(pos.astype(float))))
    if cm is not None:
        with np.errstate(invalid="ignore"):
            d = np.maximum(0.0, np.diff(cm)) / 100
            map_rate = np.minimum(0.5, 0.5 * (1 - np.exp(-2 * d)))
        out = np.where(np.isfinite(map_rate), map_rate, out)
    return out


def tree(taxa: list[str], parents: list[str | None]) -> tuple[list[int], list[int], int]:
    """(parent number or -1, depth, root) of a family; exactly one root, no cycle."""
    at = {t: i for i, t in reversed(list(enumerate(taxa)))}
    up = [at.get(p, -1) if p is not None else -1 for p in parents]
    roots = [i for i, p in enumerate(up) if p < 0]
    if len(roots) != 1:
        raise ValueError(f"a family must have exactly one root (got {len(roots)})")
    depth = []
    for i in range(len(taxa)):
        d, j = 0, i
        while up[j] >= 0:
            j, d = up[j], d + 1
            if d > len(taxa):
                raise ValueError("a family's pedigree contains a cycle")
        depth.append(d)
    return up, depth, roots[0]


#: Cells (positions times taxa) of a group of chains that are passed over at once, and cells
#: of the blocks of chains that lie side by side at a step.
GROUP_CELLS, ABREAST = 8_000_000, 12_288


class _Group:
    """Taxa of one depth that all have children or all have none. Arrays are
    [position, state, taxon]; ``up`` and ``down`` are the messages to and from the parents.
    Positions are ``blocks`` of equal length; beyond the last one nothing is said."""

    def __init__(self, nodes: list[int], leaves: bool, m: int, root: bool) -> None:
        self.nodes, self.leaves, self.root = nodes, leaves, root
        self.blocks = max(1, min(ABREAST // len(nodes), math.isqrt(m)))
        self.padded = -(-m // self.blocks) * self.blocks
        self.up = self.down = None if root else np.full((self.padded, 3, len(nodes)), 1 / 3)
        if not root:
            self.down = self.up.copy()


class Family:
    """``observed``: per taxon None or (positions, likelihoods [.., state] there); other
    positions say nothing."""

    def __init__(self, up, meioses, observed, start, stationary, rates) -> None:
        self.parent, self.m, self.observed = up, len(rates) + 1, observed
        self.start, self.stationary = np.array(start, float), np.array(stationary, float)
        # a step keeps the state with 1 - r or draws it anew from the stationary shares
        self.fresh = {k: 0.5 * (1 - (1 - 2 * rates) ** max(1, k)) for k in set(meioses)}
        self.meioses = meioses
        kids: dict[int, list[int]] = {}
        for v, p in enumerate(up):
            kids.setdefault(p, []).append(v)
        self.levels: list[list[_Group]] = []
        self.place: dict[int, tuple[_Group, int]] = {}
        layer = kids[-1]
        most = max(1, GROUP_CELLS // self.m)
        while layer:
            groups = []
            for leaves in (False, True):
                # children of one parent lie side by side; taxa of a group share their steps
                some = [v for v in layer if (v not in kids) == leaves]
                kinds: dict[tuple, list[int]] = {}
                for v in some:
                    kinds.setdefault((meioses[v], *self.stationary[v]), []).append(v)
                for alike in kinds.values():
                    groups += [_Group(alike[i : i + most], leaves, self.m, not self.levels) for i in range(0, len(alike), most)]
            self.place |= {v: (g, k) for g in groups for k, v in enumerate(g.nodes)}
            self.levels.append(groups)
            layer = [c for v in layer for c in kids.get(v, ())]
        self.spans = {v: self._spans(c) for v, c in kids.items() if v >= 0}
        self.inner: dict[int, np.ndarray] = {}  # beliefs of taxa with children
        for g in (g for level in self.levels for g in level):
            g.cells = self._cells(g)
        self.room = np.empty(3 * max((g.padded * len(g.nodes) for level in self.levels for g in level if g.leaves and not g.root), default=0))

    def _spans(self, nodes: list[int]) -> list[tuple[_Group, int, int]]:
        """Where children lie: (group, first, end) of runs of columns."""
        out: list[tuple[_Group, int, int]] = []
        for g, k in (self.place[v] for v in nodes):
            if out and out[-1][0] is g and out[-1][2] == k:
                out[-1] = (g, out[-1][1], k + 1)
            else:
                out.append((g, k, k + 1))
        return out

    def _cells(self, g: _Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, column, likelihoods) of what the group's taxa have observed, by position."""
        seen = [(k, *self.observed[v]) for k, v in enumerate(g.nodes) if self.observed[v] is not None]
        if not seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3))
        at, likelihood = (np.concatenate([x[i] for x in seen]) for i in (1, 2))
        taxon = np.repeat([x[0] for x in seen], [len(x[1]) for x in seen])
        order = np.argsort(at, kind="stable")
        return at[order], taxon[order], likelihood[order]

    def _from_children(self, v: int) -> np.ndarray:
        """Product of the children's messages, scaled as it grows: hundreds of them
        would leave the range of floats."""
        out = np.ones((self.m, 3))
        for g, i, j in self.spans.get(v, ()):
            for a, b in _chunks(self.m, j - i):
                out[a:b] *= _product(g.up[a:b, :, i:j])
            out /= out.max(axis=1, keepdims=True)
        return out

    def _chain(self, g: _Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, stationary shares and rates of the group's chains."""
        return self.start[g.nodes].T.copy(), self.stationary[g.nodes[0]], self.fresh[self.meioses[g.nodes[0]]]

    def _beliefs(self, g: _Group) -> np.ndarray:
        """Forward-backward of the group's chains under the messages they have."""
        local = self._local(g)
        out = _rests(local, g.blocks, *self._chain(g), np.empty_like(local))
        with np.errstate(invalid="ignore", divide="ignore"):
            for a, b in _chunks(len(out), len(g.nodes)):
                out[a:b] *= local[a:b]
                out[a:b] /= out[a:b].sum(axis=1, keepdims=True)
        return out[: self.m] if np.isfinite(out).all() else self._plain(g, local)

    def _local(self, g: _Group) -> np.ndarray:
        local = np.ones((g.padded, 3, len(g.nodes))) if g.root else g.down.copy()
        if not g.leaves:
            for k, v in enumerate(g.nodes):
                local[: self.m, :, k] *= self._from_children(v)
        at, taxon, likelihood = g.cells
        local[at, :, taxon] *= likelihood
        return local

    def _plain(self, g: _Group, local: np.ndarray) -> np.ndarray:
        start, shares, r = self._chain(g)
        return np.stack([_plain_passes(local[: self.m, :, k], start[:, k], shares, r) for k in range(len(g.nodes))], axis=2)

    def _send_up(self, g: _Group, beliefs: np.ndarray, damping: float, enough: float) -> float:
        moved = 0.0
        for a, b in _chunks(self.m, len(g.nodes)):
            moved = max(moved, _damped(g.up[a:b], _to_parent(beliefs[a:b] / np.maximum(g.down[a:b], FLOOR)), damping, moved < enough))
        return moved

    def _leaves_up(self, g: _Group, damping: float, enough: float) -> float:
        """Messages of taxa without children. A belief over the message from the parent is
        all the rest: that message, never below the floor, is not multiplied in to be
        divided out again."""
        at, taxon, likelihood = g.cells
        held = g.down[at, :, taxon]
        g.down[at, :, taxon] = held * likelihood
        rest = _rests(g.down, g.blocks, *self._chain(g), self.room[: g.down.size].reshape(g.down.shape))
        g.down[at, :, taxon] = held
        rest[at, :, taxon] *= likelihood
        moved, plain = 0.0, None
        for a, b in _chunks(self.m, len(g.nodes)):
            target = rest[a:b]
            total = target.sum(axis=1)
            if not (total.min() > 0 and np.isfinite(total.max())):
                plain = self._plain(g, self._local(g)) if plain is None else plain
                target = plain[a:b] / np.maximum(g.down[a:b], FLOOR)
            moved = max(moved, _damped(g.up[a:b], _to_parent(target), damping, moved < enough))
        return moved

    def run(self, rounds: int = 30, tol: float = 1e-4, damping: float = 0.5) -> int:
        """Rounds used. A taxon without children hears from its parent alone: what it says
        next follows as soon as its chain is passed, so that nothing is passed twice. Moves
        are measured until one of the round reaches ``tol``."""
        used, ahead = 0, 0.0
        for g in (g for level in self.levels[1:] for g in level if g.leaves):
            ahead = max(ahead, self._leaves_up(g, damping, tol))
        for used in range(1, rounds + 1):
            moved, ahead = ahead, 0.0
            for level in reversed(self.levels):
                for g in level:
                    if g.leaves and not g.root:
                        continue
                    beliefs = self._beliefs(g)
                    self._keep(g, beliefs)
                    if not g.root:
                        moved = max(moved, self._send_up(g, beliefs, damping, tol))
            later = []
            for depth, level in enumerate(self.levels[:-1]):
                for g in level:
                    if not g.leaves and not g.root:
                        self._keep(g, self._beliefs(g))
                for v in (v for g in level if not g.leaves for v in g.nodes):
                    for g, i, j in self.spans[v]:
                        for a, b in _chunks(self.m, j - i):
                            target = _to_children(self.inner[v][a:b, :, None] / g.up[a:b, :, i:j])
                            moved = max(moved, _damped(g.down[a:b, :, i:j], target, damping, moved < tol))
                later += [g for g in self.levels[depth + 1] if g.leaves]
            if moved < tol or used == rounds:
                break
            for g in later:
                ahead = max(ahead, self._leaves_up(g, damping, tol))
        return used

    def _keep(self, g: _Group, beliefs: np.ndarray) -> None:
        if not g.leaves or g.root:
            self.inner |= {v: beliefs[:, :, k] for k, v in enumerate(g.nodes)}

    def posteriors(self):
        """(taxon, [position, state]) of every taxon."""
        for level in self.levels:
            for g in level:
                beliefs = None if all(v in self.inner for v in g.nodes) else self._beliefs(g)
                for k, v in enumerate(g.nodes):
                    yield v, self.inner[v] if beliefs is None else beliefs[:, :, k]

    def states(self):
        """(taxon, most likely state of every position) of every taxon."""
        for v, p in self.posteriors():
            yield v, p.argmax(axis=1)


#: Cells that are worked on in one go, so that they stay in the processor's cache, and
#: positions passed between two scalings, which keep floats in range.
AT_ONCE, UNSCALED = 8_192, 16


def _chunks(m: int, n: int) -> list[tuple[int, int]]:
    """Bounds of runs of positions of ``n`` chains."""
    step = max(1, AT_ONCE // max(n, 1))
    return [(i, min(m, i + step)) for i in range(0, m, step)]


def _product(x: np.ndarray) -> np.ndarray:
    """Product over taxa, the last axis, up to a factor a position: by halves, scaled from the third on."""
    halved = 0
    while (n := x.shape[2]) > 1:
        y = x[:, :, : n // 2] * x[:, :, n // 2 : n // 2 * 2]
        if n % 2:
            y[:, :, 0] *= x[:, :, -1]
        x, halved = y, halved + 1
        if halved >= 3:
            x /= x.max(axis=1, keepdims=True)
    return x[:, :, 0]


def _to_parent(x: np.ndarray) -> np.ndarray:
    """What children's shares say of their parents, in place; floored at a share of the sum."""
    total = x[:, 0] + x[:, 2]
    x[:, 1] *= 0.5
    x[:, 1] += 0.25 * total
    total += x[:, 1]
    return _floored(x, total)


def _to_children(x: np.ndarray) -> np.ndarray:
    """What a parent's shares say of its children, in place; floored at a share of the sum."""
    x[:, 1] *= 0.5
    half = 0.5 * x[:, 1]
    x[:, 0] += half
    x[:, 2] += half
    np.add(x[:, 0], x[:, 1], out=half)
    half += x[:, 2]
    return _floored(x, half)


def _floored(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    total *= FLOOR
    return np.maximum(x, total[:, None], out=x)


def _damped(held: np.ndarray, target: np.ndarray, damping: float, measured: bool) -> float:
    """Moves messages towards a target, which is used up; the largest move, if measured."""
    if damping == 0.5:
        target *= held
        np.sqrt(target, out=target)
    else:
        target /= target.sum(axis=1, keepdims=True)
        target = held ** (1 - damping) * target**damping
    total = target[:, 0] + target[:, 1]
    total += target[:, 2]
    np.reciprocal(total, out=total)
    if not measured:
        np.multiply(target, total[:, None], out=held)
        return 0.0
    target *= total[:, None]
    moved = float(np.abs(target - held).max(initial=0.0))
    held[...] = target
    return moved


def _rests(local: np.ndarray, blocks: int, start: np.ndarray, shares: np.ndarray, r: np.ndarray, out: np.ndarray) -> np.ndarray:
    """What the rest of its chain says of every position, up to a factor. Blocks of positions
    are passed side by side: first from each of the three states, which gives a block's
    product of steps, then both ways from what the blocks before and after it give."""
    long, n = len(local) // blocks, local.shape[2]
    here, said = local.reshape(blocks, long, 3, n), out.reshape(blocks, long, 3, n)
    weight = np.zeros(len(local))  # a step keeps the state with 1 - r, over which all is taken
    weight[1 : len(r) + 1] = r / (1 - r)
    weight = weight.reshape(blocks, long, 1)
    flat = np.ptp(shares) == 0
    gain = shares[:, None]

    def stepped(x: np.ndarray, i: int, back: bool = False) -> None:
        s = np.add(x[..., 0, :], x[..., 1, :]) if flat or not back else x[..., 0, :] * shares[0] + x[..., 1, :] * shares[1]
        s += x[..., 2, :] if flat or not back else x[..., 2, :] * shares[2]
        s *= weight[:, i] * shares[0] if flat else weight[:, i]
        x += s[..., None, :] if flat or back else s[..., None, :] * gain

    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.zeros((3, blocks, 3, n))
        for k in range(3):
            x[k, :, k] = 1
        for i in range(long if blocks > 1 else 0):
            stepped(x, i)
            x *= here[:, i]
            if i % UNSCALED == 0:
                x /= x.sum(axis=(0, 2))[:, None]
        first, last = np.empty((blocks, 3, n)), np.ones((blocks, 3, n))
        first[0] = start
        for k in range(1, blocks):
            first[k] = (x[:, k - 1] * first[k - 1][:, None]).sum(axis=0)
            first[k] /= first[k].sum(axis=0)
        for k in range(blocks - 2, -1, -1):
            last[k] = (x[:, k + 1] * last[k + 1]).sum(axis=1)
            last[k] /= last[k].sum(axis=0)
        for i in range(long):
            stepped(first, i)
            said[:, i] = first
            first *= here[:, i]
            if i % UNSCALED == 0:
                first /= first.sum(axis=1, keepdims=True)
        for i in range(long - 1, -1, -1):
            said[:, i] *= last
            last *= here[:, i]
            if i % UNSCALED == 0:
                last /= last.sum(axis=1, keepdims=True)
            stepped(last, i, True)
    return out


def _plain_passes(local: np.ndarray, start: np.ndarray, shares: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Beliefs of one chain in plain floats, flat where nothing is left."""
    m, values, fresh, (p0, p1, p2) = len(local), local.tolist(), r.tolist(), shares.tolist()
    a, b, c = (x * y for x, y in zip(start.tolist(), values[0]))
    f = []
    for i in range(m):
        if i:
            q, (x, y, z) = fresh[i - 1], values[i]
            a, b, c = ((1 - q) * a + q * p0) * x, ((1 - q) * b + q * p1) * y, ((1 - q) * c + q * p2) * z
        s = a + b + c
        a, b, c = (a / s, b / s, c / s) if s > 0 else (1 / 3, 1 / 3, 1 / 3)
        f.append((a, b, c))
    back, a, b, c = [(1 / 3, 1 / 3, 1 / 3)] * m, 1 / 3, 1 / 3, 1 / 3
    for i in range(m - 2, -1, -1):
        q, (x, y, z) = fresh[i], values[i + 1]
        a, b, c = a * x, b * y, c * z
        d = q * (p0 * a + p1 * b + p2 * c)
        a, b, c = (1 - q) * a + d, (1 - q) * b + d, (1 - q) * c + d
        s = a + b + c
        a, b, c = (a / s, b / s, c / s) if s > 0 else (1 / 3, 1 / 3, 1 / 3)
        back[i] = (a, b, c)
    return normalised(np.array(f) * np.array(back))
