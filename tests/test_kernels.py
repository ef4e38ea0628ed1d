import itertools

import numpy as np
import pytest

from mosaic_spark.functions import emissions, specs
from mosaic_spark.kernels import belief, bins, chains, fivestate, haplotypes, independent, meiosis, rigid, spline


def naive_viterbi(start, step, logs, last=False):
    score, back = start + logs[0], []
    for e in logs[1:]:
        c = score[:, None] + step
        arg = [max((i for i in range(len(start)) if c[i, k] == c[:, k].max()), default=0) if last else int(c[:, k].argmax()) for k in range(len(start))]
        back.append(arg)
        score = c.max(axis=0) + e
    path = [int(score.argmax())]
    for arg in reversed(back):
        path.append(arg[path[-1]])
    return path[::-1]


def ragged(rng, n=17):
    lengths = rng.integers(1, 40, n)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return bounds, rng.integers(-5, 0, (bounds[-1], 3)) * 1_000_000_000


@pytest.mark.parametrize("last", [False, True])
def test_batched_paths_equal_single_ones(last):
    rng = np.random.default_rng(0)
    bounds, logs = ragged(rng)
    start, step = np.array([-1, -2, -3]), rng.integers(-3, 0, (3, 3)) * 1_000_000_000
    got = chains.decode_rows(bounds, logs, lambda e, n: chains.viterbi(start, step, e, n, last))
    for i, j in zip(bounds[:-1], bounds[1:]):
        assert got[i:j].tolist() == naive_viterbi(start, step, logs[i:j], last)


@pytest.mark.parametrize("r,last", [(2, False), (2, True), (3, False), (5, True)])
def test_rigid_paths_equal_expanded_ones(r, last):
    rng = np.random.default_rng(r)
    bounds, logs = ragged(rng)
    start, step = np.array([-1, -2, -3]) * 10**9, rng.integers(-3, 0, (3, 3)) * 10**9
    low = -(10**15)
    big_start, big = np.full(3 * r, low), np.full((3 * r, 3 * r), low)
    for m in range(3):
        big_start[m * r] = start[m]
        for k in range(r - 1):
            big[m * r + k, m * r + k + 1] = 0
        big[m * r + r - 1, m * r + r - 1] = step[m, m]
        for o in {0, 1, 2} - {m}:
            big[m * r + r - 1, o * r] = step[m, o]
    got = chains.decode_rows(bounds, logs, lambda e, n: chains.rigid_viterbi(start, step, e, n, r, last))
    for i, j in zip(bounds[:-1], bounds[1:]):
        want = naive_viterbi(big_start, big, np.repeat(logs[i:j], r, axis=1), last)
        assert got[i:j].tolist() == [x // r for x in want]


def test_two_state_example():
    start, step = np.log([0.9, 0.1]), np.log([[0.9, 0.1], [0.1, 0.9]])
    e = np.log(np.tile([0.95, 0.05], (5, 1)))
    assert chains.viterbi(start, step, e[:, None], np.array([5]))[:, 0].tolist() == [0] * 5
    assert chains.viterbi(start, step, e[:, None, ::-1], np.array([5]))[:, 0].tolist() == [1] * 5


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(3)
    start, step = np.array([0.6, 0.3, 0.1]), rng.dirichlet([1, 1, 1], 3)
    logs = np.log(rng.random((4, 1, 3)))
    got = chains.posteriors(start, step, logs, np.array([4]))[:, 0]
    want = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        p = start[path[0]] * np.prod([step[a, b] for a, b in zip(path, path[1:])]) * np.exp(sum(logs[t, 0, s] for t, s in enumerate(path)))
        for t, s in enumerate(path):
            want[t, s] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def rigid_enumeration(k, n, fit, r, free_tail):
    """All segmentations into runs of at least r markers; the likelihood's recursion
    lets the last r-1 markers follow without a stay probability, the path's does not."""
    psi = rigid.emission_logs(k, n, fit.alpha, fit.beta)
    T = len(k)
    out = []
    for path in itertools.product(range(3), repeat=T):
        runs = [(s, len(list(g))) for s, g in itertools.groupby(path)]
        if min(x for _, x in runs) < r:
            continue
        ll = np.log(fit.pi[path[0]]) + psi[range(T), path].sum()
        for i, (s, m) in enumerate(runs):
            if i:
                ll += np.log(fit.A[runs[i - 1][0], s])
            last = free_tail and i == len(runs) - 1
            ll += (max(0, m - 2 * r + 1) if last else m - r) * np.log(fit.A[s, s])
        out.append((ll, path))
    return out


def rigid_arrays(k, n, fit, r):
    psi = rigid.emission_logs(k, n, fit.alpha, fit.beta).T[None].transpose(2, 1, 0)
    return np.log(fit.pi), np.log(fit.A), psi, rigid.window_sums(psi, r), np.array([len(k)]), r


def test_rigid_likelihood_and_path_equal_enumeration():
    rng = np.random.default_rng(8)
    n = rng.integers(1, 5, 8)
    k = rng.binomial(n, [0.95] * 4 + [0.1] * 4)
    fit = rigid.RigidFit(np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.3, 0.6]]), np.array([0.5, 0.2, 0.3]), np.array([20.0, 10, 1]), np.array([1.0, 10, 20]))
    for r in (2, 3):
        every, full = rigid_enumeration(k, n, fit, r, True), rigid_enumeration(k, n, fit, r, False)
        pi, a, psi, sums, length, _ = rigid_arrays(k, n, fit, r)
        fwd, bwd = rigid.forward(pi, a, psi, sums, length, r), rigid.backward(a, psi, sums, length, r)
        total = np.logaddexp.reduce((fwd[r - 1] + bwd[r - 1])[:, 0])
        assert total == pytest.approx(np.logaddexp.reduce([x for x, _ in every]))
        assert tuple(rigid.paths(pi, a, psi, sums, length, r)[:, 0]) == max(full)[1]
        _, share = rigid.expectations(fwd, bwd, a, psi, sums, length, r)
        assert np.allclose(share.sum(axis=1), 1)


def test_rigid_padding_changes_nothing():
    rng = np.random.default_rng(2)
    fit = rigid.first_fit(*rigid.initial())
    r, sizes = 3, [14, 9, 6]
    n = [rng.integers(1, 6, s) for s in sizes]
    k = [rng.binomial(x, 0.7) for x in n]
    psi = np.zeros((14, 3, 3))
    for c, (kk, nn) in enumerate(zip(k, n)):
        psi[: len(kk), :, c] = rigid.emission_logs(kk, nn, fit.alpha, fit.beta)
    length = np.array(sizes)
    pi, a = np.log(fit.pi), np.log(fit.A)
    sums = rigid.window_sums(psi, r)
    fwd, bwd = rigid.forward(pi, a, psi, sums, length, r), rigid.backward(a, psi, sums, length, r)
    moves, share = rigid.expectations(fwd, bwd, a, psi, sums, length, r)
    path = rigid.paths(pi, a, psi, sums, length, r)
    for c, (kk, nn) in enumerate(zip(k, n)):
        p1, a1, psi1, s1, l1, _ = rigid_arrays(kk, nn, fit, r)
        f1, b1 = rigid.forward(p1, a1, psi1, s1, l1, r), rigid.backward(a1, psi1, s1, l1, r)
        m1, g1 = rigid.expectations(f1, b1, a1, psi1, s1, l1, r)
        assert np.allclose(moves[:, :, c], m1[:, :, 0]) and np.allclose(share[: len(kk), :, c], g1[:, :, 0])
        assert (path[: len(kk), c] == rigid.paths(p1, a1, psi1, s1, l1, r)[:, 0]).all()


def test_border_moves_to_the_best_split():
    psi = np.log(np.array([[0.9, 0.1]] * 4 + [[0.1, 0.9]] * 4))
    assert rigid.replaced_borders(np.array([0, 0, 1, 1, 1, 1, 1, 1]), psi).tolist() == [0] * 4 + [1] * 4


def test_brent():
    assert rigid.golden_brent(lambda x: (x - 2.3) ** 2 + 1, 0, 10) == pytest.approx(2.3, abs=1e-6)


def test_gaussian_bins_find_a_block():
    rng = np.random.default_rng(0)
    share = np.abs(rng.normal(0.02, 0.01, 200))
    share[80:120] = rng.normal(0.9, 0.05, 40)
    start = np.array([0.86, 0.03, 0.11])
    states = bins.gaussian_states(share, np.ones(200, int), start)
    assert (states[85:115] == 2).all() and (states[:75] == 0).all()
    assert not bins.gaussian_states(np.abs(rng.normal(0.02, 0.01, 200)), np.ones(200, int), start).any()
    assert not bins.gaussian_states(np.array([0.5]), np.ones(1, int), start).any()


def test_clusters():
    x = np.array([0, 0.1, 0.11, 0.12, 0.5, 0.52, 0.9, 0.91, 0.93])
    for method in ("gmm", "kmeans"):
        assert bins.cluster_states(x, method).tolist() == [0, 0, 0, 0, 1, 1, 2, 2, 2]
    assert bins.cluster_states(np.array([0.2, 0.2, 0.9, 0.9]), "kmeans").tolist() == [0, 0, 2, 2]
    assert not bins.cluster_states(np.array([0.5, 0.5, 0.5]), "gmm").any()
    with pytest.raises(RuntimeError):
        bins.cluster_states(x, "rebmix")


@pytest.mark.parametrize("method", ["gmm", "kmeans"])
def test_values_that_stand_for_rows_cluster_like_the_rows(method):
    rng = np.random.default_rng(5)
    values = np.sort(np.unique(np.round(rng.random(40), 3)))
    counts = rng.integers(1, 30, len(values))
    weight = np.repeat(rng.integers(1, 5, len(values)), counts).astype(float) if method == "gmm" else None
    at = np.repeat(np.arange(len(values)), counts)
    rows = bins.cluster_states(values[at], method, weight)
    got = bins.cluster_states(values, method, None if weight is None else np.bincount(at, weight), counts.astype(float))
    assert (got[at] == rows).all() and len(set(rows.tolist())) == 3


def test_kmeans_is_optimal():
    rng = np.random.default_rng(5)
    x = np.sort(rng.random(12))
    label = bins.k_means(x, 3)
    cost = lambda cuts: sum(((x[i:j] - x[i:j].mean()) ** 2).sum() for i, j in zip((0, *cuts), (*cuts, 12)))
    best = min(cost(c) for c in itertools.combinations(range(1, 12), 2))
    assert cost(tuple(np.flatnonzero(np.diff(label)) + 1)) == pytest.approx(best)


def g(*rows):
    return np.array(rows)


def test_gap_fill():
    assert haplotypes.fill_gaps(g([0, 3, 3, 0, 2, 3, 0, 1, 3, 1], [3, 3, 0, 0, 3, 3, 3, 3, 3, 3])).tolist() == [[0, 0, 0, 0, 2, 3, 0, 1, 1, 1], [3, 3, 0, 0, 3, 3, 3, 3, 3, 3]]


def test_segregating_sites():
    cols = np.full((120, 4), 0)
    cols[:30, 0], cols[:60, 1], cols[0, 3] = 2, 2, 1
    assert haplotypes.segregating(cols, 1.0, 0.25).tolist() == [True, False, False, False]
    assert haplotypes.segregating(cols, 1.0, 0.5).tolist() == [False, True, False, False]


def test_same_tag():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 2, 60) * 2 for _ in range(3))
    m = np.column_stack([a, a, a, b, c])
    assert haplotypes.same_tag_keep(m, np.array([100, 140, 150, 170, 200]), np.ones(5, bool)).tolist() == [True, False, False, True, True]
    with pytest.raises(ValueError):
        haplotypes.same_tag_keep(m, np.array([5, 4, 3, 2, 1]), np.ones(5, bool))


def test_tag_filter():
    rng = np.random.default_rng(2)
    site = rng.integers(0, 2, 40) * 2
    m = np.column_stack([site] * 4)
    m[:5] = 3
    assert haplotypes.tag_filter(m, np.array([100, 140, 300, 360]), 0.05, 0.8).tolist() == [True, False, True, False]


def test_haplotype_clusters():
    pool = g(*[[0, 0, 2, 2, 0, 0]] * 3, *[[2, 2, 0, 0, 2, 2]] * 2, [3] * 6)
    w = haplotypes.Window(pool)
    assert w.sizes.tolist() == [4, 3] and w.scores.tolist() == [3.5, 2.5]
    a, b = [0] * 10, [0] * 9 + [2]
    near = haplotypes.Window(g(a, a, a, b, b, b))
    assert len(near.member) == 2
    assert near.join_near(2).sizes.tolist() == [6]
    assert haplotypes.distance(np.array([0, 1, 3, 2]), np.array([2, 0, 0, 2])) == 3


def test_members_move_up_and_mixed_clusters_go():
    a, b = [0] * 8, [2] * 8
    part = [0, 0, 3, 3, 3, 3, 3, 3]
    w = haplotypes.Window(g(a, a, part, b, b, [1] * 8)).draw_up(0)
    assert w.sizes.tolist() == [3, 2, 1] and w.without_het(5).sizes.tolist() == [3, 2]
    calls = np.array([[3, 1, 0], [0, 1, 0], [2, 1, 0]])
    assert haplotypes.consensus(calls, "majority").tolist() == [0, 3, 3]
    assert haplotypes.consensus(calls, "unanimous").tolist() == [3, 3, 3]
    assert haplotypes.consensus(calls, "censored").tolist() == [0, 0, 3]


def test_candidates_go_to_the_parent_they_match():
    p, q = np.zeros(100, int), np.full(100, 2)
    near_p, between = p.copy(), p.copy()
    near_p[[3, 50]] = 2
    between[:12] = 2
    got = haplotypes.sides([p[None], q[None]], np.stack([near_p, q, between]), True)
    assert [len(x) for x in got] == [2, 1]
    a, c = haplotypes.parent_calls([np.array([[0, 1, 0, 3]]), np.array([[2, 2, 0, 2]])])
    assert a.tolist() == [0, 3, 3, 3] and c.tolist() == [2, 2, 3, 2]
    a, c = haplotypes.parent_calls([np.array([[0, 0, 0], [0, 2, 3]]), np.array([[2, 2, 0]])])
    assert a.tolist() == [0, 3, 3] and c.tolist() == [2, 3, 3]


def test_gaussian_batch_equals_single_samples():
    rng, start = np.random.default_rng(11), np.array([0.86, 0.03, 0.11])
    parts, chroms = [], []
    for k, n in enumerate((120, 3, 60, 1, 200)):
        x = np.abs(rng.normal(0.02, 0.01, n))
        x[n // 3 : n // 2] += 0.45 * (k % 3)
        parts.append(x)
        chroms.append(np.sort(rng.integers(1, 4, n)))
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    got = bins.gaussian_batch(np.concatenate(parts), np.concatenate(chroms), bounds, start)
    for i, j, x, c in zip(bounds[:-1], bounds[1:], parts, chroms):
        assert (got[i:j] == bins.gaussian_states(x, c, start)).all()
    assert got.any()


def family(rng, taxa=120, sites=350):
    a, c = rng.integers(0, 2, sites) * 2, None
    c = 2 - a
    truth = np.zeros((taxa, sites), int)
    for t in range(taxa):
        cut = np.sort(rng.integers(0, sites, 2))
        truth[t, cut[0] : cut[1]] = 2
        if t % 2:
            truth[t] = 2 - truth[t]
    seen = np.where(truth == 0, a, c)
    seen[rng.random(seen.shape) < 0.1] = 3
    return truth, seen, a


def test_biparental_parents_are_found():
    rng = np.random.default_rng(4)
    truth, seen, a = family(rng)
    got_a, got_c, seeded = haplotypes.biparental_alleles(seen)
    known = (got_a != 3) & (got_c != 3)
    assert seeded and known.mean() > 0.6
    agree = (got_a[known] == a[known]).mean()
    assert agree > 0.99 or agree < 0.01
    out, sites, taxa = haplotypes.call_biparental(seen, np.arange(350) * 1000)
    assert len(sites) > 200 and len(taxa) == 120


def test_imputation_recovers_the_family():
    rng = np.random.default_rng(6)
    truth = np.zeros((60, 200), int)
    truth[:20, 50:120] = 2
    seen = np.where(rng.random(truth.shape) < 0.2, 3, truth)
    out, used = fivestate.impute(seen, np.arange(200) * 1000, 0.03)
    out = haplotypes.fill_gaps(out)
    assert used < 50 and (out == truth)[out != 3].mean() > 0.99 and (out != 3).mean() > 0.95


def test_belief_of_a_small_family():
    emission = specs.GenotypeEmission()
    prior = np.array([0.75, 0.25, 0.0])
    logs = [None, (np.arange(20), emission.matrix().T[np.full(20, 2)]), None]
    start = [prior, np.full(3, 1 / 3), np.full(3, 1 / 3)]
    fam = belief.Family([-1, 0, 0], [3, 4, 4], logs, start, start, np.full(19, 0.01))
    fam.run()
    assert (dict(fam.states())[1] == 2).all() and (dict(fam.posteriors())[2][:, 0] < 1 / 3 - 0.02).all()


def plain_family(up, meioses, observed, start, rates, rounds, damping=0.5):
    """Messages taxon by taxon, every chain passed anew whenever it is asked."""
    m, n = len(rates) + 1, len(up)
    kids = [[c for c, p in enumerate(up) if p == v] for v in range(n)]
    depth = [0] * n
    for v in range(n):
        p = up[v]
        while p >= 0:
            depth[v], p = depth[v] + 1, up[p]
    before = sorted(range(n), key=lambda v: depth[v])
    to_parent, to_child = ([np.full((m, 3), 1 / 3) for _ in up] for _ in "ab")

    def passed(v):
        local = np.ones((m, 3)) if up[v] < 0 else to_child[v].copy()
        for c in kids[v]:
            local = local * to_parent[c]
        if observed[v] is not None:
            local[observed[v][0]] *= observed[v][1]
        return belief._plain_passes(local, start[v], start[v], 0.5 * (1 - (1 - 2 * rates) ** meioses[v]))

    def moved(old, b, without, link):
        cavity = belief.normalised(b / np.maximum(without, 1e-12))
        target = belief.normalised(cavity @ link)
        return belief.normalised(np.maximum(old, 1e-12) ** (1 - damping) * np.maximum(target, 1e-12) ** damping)

    for _ in range(rounds):
        for v in before[:0:-1]:
            to_parent[v] = moved(to_parent[v], passed(v), to_child[v], belief.SELFED.T)
        for v in before:
            b = passed(v)
            for c in kids[v]:
                to_child[c] = moved(to_child[c], b, to_parent[c], belief.SELFED)
    return [passed(v) for v in range(n)]


@pytest.mark.parametrize("up", [[-1] + [0] * 12, [-1, 0, 0, 1, 1, 2, 3, 3] + [4] * 9, [-1, 0, 1, 2]])
@pytest.mark.parametrize("damping", [0.5, 0.3])
def test_belief_of_levels_equals_belief_of_taxa(up, damping, monkeypatch):
    rng, m = np.random.default_rng(3), 15
    monkeypatch.setattr(belief, "GROUP_CELLS", 5 * m)
    observed = [None if rng.random() < 0.3 else (np.sort(rng.choice(m, 4, replace=False)), rng.random((4, 3))) for _ in up]
    start = [np.array([0.7, 0.1, 0.2]) if p < 0 else np.full(3, 1 / 3) for p in up]
    meioses, rates = [3 + (v > 0) for v in range(len(up))], rng.random(m - 1) * 0.2
    fam = belief.Family(up, meioses, observed, start, start, rates)
    assert fam.run(4, 0.0, damping) == 4
    want = plain_family(up, meioses, observed, start, rates, 4, damping)
    got = dict(fam.posteriors())
    assert all(np.allclose(got[v], want[v], atol=1e-9) for v in range(len(up)))


def test_belief_holds_its_messages_and_one_array_more():
    import tracemalloc

    rng, m, n = np.random.default_rng(4), 4000, 40
    observed = [None, *((np.sort(rng.choice(m, 9, replace=False)), rng.random((9, 3))) for _ in range(n))]
    start = [np.array([0.7, 0.3, 0.0])] + [np.full(3, 1 / 3)] * n
    tracemalloc.start()
    belief.Family([-1] + [0] * n, [3] + [4] * n, observed, start, start, np.full(m - 1, 1e-3)).run(2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.75 * (m * 3 * n * 8)


@pytest.mark.parametrize("m", [1, 2, 40, 1000])
@pytest.mark.parametrize("shares", [np.full(3, 1 / 3), np.array([0.7, 0.3, 0.0])])
def test_blocks_of_a_chain_equal_the_chain(m, shares):
    rng = np.random.default_rng(m)
    seen, r, start = rng.random((m, 3)) ** 6, rng.random(m - 1) * 0.01, np.array([0.5, 0.4, 0.1])
    fam = belief.Family([-1], [1], [(np.arange(m), seen)], [start], [shares], r)
    assert np.allclose(dict(fam.posteriors())[0], belief._plain_passes(seen, start, shares, r), atol=1e-12)
    seen[m // 2] = 0  # nothing is left there: the chain begins anew
    fam = belief.Family([-1], [1], [(np.arange(m), seen)], [start], [shares], r)
    assert np.allclose(dict(fam.posteriors())[0], belief._plain_passes(seen, start, shares, r), atol=1e-12)


def test_pedigree_trees():
    assert belief.tree(["r", "a", "b"], [None, "r", "a"]) == ([-1, 0, 1], [0, 1, 2], 0)
    with pytest.raises(ValueError, match="exactly one root"):
        belief.tree(["a", "b"], [None, None])
    with pytest.raises(ValueError, match="cycle"):
        belief.tree(["r", "a", "b"], [None, "b", "a"])


def test_interval_rates():
    pos = np.array([0, 10, 1000])
    assert belief.interval_rates(pos).tolist() == [0.1, 0.5]
    assert np.allclose(belief.interval_rates(pos, np.array([0, 1, np.nan])), [0.5 * (1 - np.exp(-0.02)), 0.5])


def test_independent_sets():
    ring = np.zeros((6, 6), bool)
    for i in range(6):
        ring[i, (i + 1) % 6] = ring[(i + 1) % 6, i] = True
    best, sets, counts = independent.independent_sets(ring, 20, 3)
    assert best in ([0, 2, 4], [1, 3, 5]) and sets[0] == [0, 2, 4] and sum(counts.values()) == len(sets)
    clique = np.ones((5, 5), bool)
    clique[4] = clique[:, 4] = False
    assert independent.independent_sets(clique)[0] == [0, 4]
    assert independent.independent_sets(np.ones((3, 3), bool))[0] == [0]
    assert independent.independent_sets(np.zeros((4, 4), bool))[0] == [0, 1, 2, 3]
    for s in sets:
        assert not ring[np.ix_(s, s)].any()


def test_spline_follows_the_data():
    x = np.array([0, 1, 2, 3, 5, 8, 9.0])
    y = np.array([0, 0, 0.1, 5, 5.1, 5.1, 9])
    f = spline.MonotoneCurve(x, y)
    assert np.allclose(f(x), y) and (np.diff(f(np.linspace(0, 9, 500))) >= -1e-9).all()
    assert f(-5) == 0 and f(50) == 9
    cubic = spline.spline_slopes(x, x**3 - 2 * x)
    assert np.allclose(cubic, 3 * x**2 - 2)
    assert spline.MonotoneCurve([0, 0, 1], [0, 2, 5])(0) == 1
    with pytest.raises(ValueError):
        spline.MonotoneCurve([1, 1], [0, 1])


def test_meiosis():
    rng = np.random.default_rng(1)
    a, b = meiosis.founder(150.0, 1), meiosis.founder(150.0, 2)
    n = np.mean([len(meiosis.crossovers(150.0, rng)) for _ in range(2000)])
    assert n == pytest.approx(1.5, abs=0.08)
    share = np.mean([(meiosis.alleles_at(meiosis.gamete(a, b, rng), np.linspace(1, 149, 50)) == 2).mean() for _ in range(800)])
    assert share == pytest.approx(0.5, abs=0.04)
    hap = (np.array([10.0, 20.0]), np.array([1, 2]))
    assert meiosis.alleles_at(hap, np.array([0, 10, 10.5, 20])).tolist() == [1, 1, 2, 2]
    assert (emissions.fixed(np.array([-1.0])) == -emissions.NANO).all()
