"""The ancestry callers: observations in, a state per marker or bin out.

Relational work (filters, hard calls, bins, joins) is Spark's; only the recursions
along a chain run as numpy kernels over clustered rows. Results are lazy, but for
``rtiger``'s fit and pooled ``binhmm`` clustering, which need the whole cohort."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import design as designs
from ..functions.emissions import NANO, count_emission, fixed, genotype_emission, hard_call, low_coverage_emission
from ..functions.specs import CountEmission, GenotypeEmission, Transition, caller_spec, transition
from ..kernels import belief, bins, fivestate, haplotypes, rigid
from ..kernels.chains import batches_of, decode_rows, padded, posteriors, rigid_viterbi, viterbi
from ..schema import DEFAULT_SOURCE, SchemaError, has, require, with_donor
from .blocks import append, by_unit, column, runs, unit_bounds
from .segments import bin_counts, to_segments

CHAIN = ["name", "chr"]
KEEP = ["donor", "name", "chr", "pos"]
STATE_SCHEMA = "donor string, name string, chr int, pos long, state int"
SEGMENT_SCHEMA = "source string, donor string, name string, chr int, start_bp long, end_bp long, state int"
#: Tasks that families' chromosomes are dealt to at most.
MOST_TASKS = 1_000
CALLERS = ("nnil", "bbnil", "catiger", "rtiger", "googa", "atlas", "binhmm", "lbimpute", "fsfhap", "pedigree")


class NoData(ValueError):
    """Nothing is left to call."""


def _state_frame(df: DataFrame, source: str) -> DataFrame:
    extra = [c for c in ("start_bp", "end_bp") if c in df.columns]
    return df.select(F.lit(source).alias("source"), "donor", "name", "chr", "pos", *extra, "state")


def _logs(p: np.ndarray, exact: bool) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return fixed(np.log(p)) if exact else np.log(p)


def decode_logs(bounds: np.ndarray, logs: np.ndarray, chain: Transition, last_ties: bool, exact: bool = True) -> np.ndarray:
    """Best states of rows in chains. Fixed point by default: ties are then the same
    in every engine and on every partitioning."""
    start, step = _logs(chain.start, exact), _logs(chain.step, exact)
    values = fixed(logs) if exact else logs
    run = lambda e, n: rigid_viterbi(start, step, e, n, chain.rigid, last_ties) if chain.rigid > 1 else viterbi(start, step, e, n, last_ties)
    return decode_rows(bounds, values, run)


def fit_theta(chains: list[tuple[np.ndarray, np.ndarray]], emission: CountEmission, chain: Transition, theta=None, rounds: int = 100, tol: float = 1e-5) -> tuple:
    """Mean alternative shares of one sample's states by EM over its chains of
    (depth, alt); a state without weight keeps its mean."""
    theta = np.array(theta or emission.theta, float)
    n, a = (np.concatenate([c[k] for c in chains]) for k in (0, 1))
    bounds = np.concatenate([[0], np.cumsum([len(c[0]) for c in chains])])
    eps = 1e-4
    for _ in range(rounds):
        logs = count_emission(n - a, a, emission, tuple(theta))
        top, bottom = np.zeros(3), np.zeros(3)
        for some, length in batches_of(bounds):
            starts = bounds[:-1][some]
            g = posteriors(chain.start, chain.step, padded(logs, starts, length), length)
            inside = (np.arange(length[0])[:, None] < length[None, :])[:, :, None]
            g = g * inside
            top += (g * padded(a, starts, length)[:, :, None]).sum(axis=(0, 1))
            bottom += (g * padded(n, starts, length)[:, :, None]).sum(axis=(0, 1))
        new = np.where(bottom > eps, np.clip(top / np.maximum(bottom, eps), eps, 1 - eps), theta)
        moved, theta = np.abs(new - theta).max(), new
        if moved < tol:
            break
    return tuple(theta.tolist())


# ---------------------------------------------------------------- grid callers


def _collapsed(duration, f_1, f_2) -> Transition:
    t = transition(duration, f_1, f_2)
    return Transition(t.start, t.step, 1)


def _grid_kernel(emission, chain: Transition, flat: Transition, exact: bool, finish):
    """States of whole chains; with fitted means, of whole samples."""
    last_ties = isinstance(emission, GenotypeEmission)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        bounds = unit_bounds(batch, CHAIN)
        if last_ties:
            logs = genotype_emission(column(batch, "g"), emission)
        elif emission.fit_means:
            r, a = column(batch, "n_ref").astype(np.int64), column(batch, "n_alt").astype(np.int64)
            logs = np.zeros((len(batch), 3))
            sample = unit_bounds(batch, ["name"])
            for i, j in zip(sample[:-1], sample[1:]):
                inner = bounds[(bounds >= i) & (bounds <= j)]
                theta = fit_theta([((r + a)[x:y], a[x:y]) for x, y in zip(inner[:-1], inner[1:])], emission, flat)
                logs[i:j] = count_emission(r[i:j], a[i:j], emission, theta)
        else:
            logs = count_emission(column(batch, "n_ref"), column(batch, "n_alt"), emission)
        return finish(batch, bounds, logs, last_ties)

    return kernel


def _grid_states(df: DataFrame, emission, duration, priors, source, exact: bool) -> DataFrame:
    chain, flat = transition(duration, *priors), _collapsed(duration, *priors)
    value = ["g"] if isinstance(emission, GenotypeEmission) else ["n_ref", "n_alt"]
    keys, order = (["name"], ["chr", "pos"]) if isinstance(emission, CountEmission) and emission.fit_means else (CHAIN, ["pos"])

    def finish(batch, bounds, logs, last_ties):
        state = decode_logs(bounds, logs, chain, last_ties, exact)
        return append(batch, KEEP, state=pa.array(state, pa.int32()))

    out = by_unit(df, keys, order, [*KEEP, *value], _grid_kernel(emission, chain, flat, exact, finish), STATE_SCHEMA)
    return _state_frame(out, source)


# ---------------------------------------------------------------- low coverage


def _coordinate(df: DataFrame, unit: str, recombdist, who: str) -> str:
    if unit not in ("bp", "cm"):
        raise ValueError(f"{who}: unit must be 'bp' or 'cm'")
    if unit == "cm" and "cm" not in df.columns:
        raise SchemaError(f"{who}: unit = 'cm' needs a `cm` column of map positions")
    values = np.atleast_1d(np.asarray(recombdist, float))
    if (values <= 0).any():
        raise ValueError(f"{who}: recombdist must be > 0")
    if unit == "cm" and (values > 1000).any():
        warnings.warn(f"{who}: unit = 'cm' but recombdist has bp-sized values (> 1000); cM distances are about 50", stacklevel=3)
    if unit == "bp" and (values < 1000).any():
        warnings.warn(f"{who}: unit = 'bp' but recombdist has cM-sized values (< 1000); bp distances are about 1e7", stacklevel=3)
    return "cm" if unit == "cm" else "pos"


def _checked_coordinate(df: DataFrame, at: str) -> DataFrame:
    bad = F.col(at).isNull()
    if at == "pos" and dict(df.dtypes)["pos"] in ("double", "float"):
        bad = bad | (F.col(at) != F.floor(at))
    return df.withColumn("__at", F.when(bad, F.raise_error(F.lit(f"lbimpute: `{at}` must be known, and whole for base pairs"))).otherwise(F.col(at).cast("double")))


def _start(design, f_1, f_2) -> np.ndarray:
    if design is None and (f_1 is None or f_2 is None):
        return np.full(3, 1 / 3)
    h, a = designs.state_frequencies(design, f_1, f_2)
    return np.array([1 - h - a, h, a])


def gap_moves(distance: np.ndarray, recombdist: float, drp: bool, exact: bool) -> np.ndarray:
    """Log moves [.., from, to, chain] over a distance: stay, one recombination, and
    between homozygotes two (one with ``drp``). No distance, no move."""
    e = np.exp(-distance / recombdist)
    stay, move = _logs(0.5 * (1 + e), exact), _logs(0.5 * (1 - e), exact)
    double = move if drp else 2 * move
    return np.stack([np.stack([stay, move, double]), np.stack([move, stay, move]), np.stack([double, move, stay])])


def _distance_states(bounds, logs, at, start, recombdist, drp, exact) -> np.ndarray:
    first, values = _logs(start, exact), fixed(logs) if exact else logs

    def run(e, length, x):
        gaps = np.diff(x, axis=0)
        inside = np.arange(1, len(x))[:, None] < length[None, :]
        if (gaps[inside] < 0).any():
            raise ValueError("lbimpute: the coordinate must not decrease along a chain")
        return viterbi(first, lambda t: gap_moves(gaps[t - 1], recombdist, drp, exact), e, length)

    return decode_rows(bounds, values, run, at)


# ---------------------------------------------------------------- rtiger


def _prepared_chains(data: DataFrame) -> DataFrame:
    """Chains clustered and sorted once, for every EM round; evicted or lost parts
    are rebuilt from the input."""
    rows = data.select(*KEEP, "n_ref", "n_alt").withColumn("__unit", F.xxhash64(*CHAIN))
    return rows.repartition("__unit").sortWithinPartitions("__unit", *CHAIN, "pos").persist(StorageLevel.MEMORY_AND_DISK)


def check_coverage(data: DataFrame, rigidity: int) -> None:
    """A rigid chain needs twice its rigidity in covered markers; names offenders."""
    short = data.groupBy(*CHAIN).count().where(F.col("count") < 2 * rigidity)
    first = short.orderBy("name", "chr").limit(11).collect()
    if first:
        listed = ", ".join(f"{r['name']} chr{r['chr']} ({r['count']} markers)" for r in first[:10])
        raise NoData(f"rtiger: chain(s) below 2*rigidity = {2 * rigidity} covered markers{' (first 10)' if len(first) > 10 else ''}: {listed}")


def _rigid_groups(batch, fit: rigid.RigidFit, r: int):
    bounds = unit_bounds(batch, CHAIN)
    k = column(batch, "n_ref").astype(np.int64)
    n = k + column(batch, "n_alt")
    logs = rigid.emission_logs(k, n, fit.alpha, fit.beta)
    for chains, length in batches_of(bounds, 1_000_000):
        starts = bounds[:-1][chains]
        inside = np.arange(length[0])[:, None] < length[None, :]
        psi = np.where(inside[:, :, None], padded(logs, starts, length), 0.0).transpose(0, 2, 1)
        at = starts[None, :] + np.arange(length[0])[:, None]
        yield k, n, logs, psi, rigid.window_sums(psi, r), length, inside, at


def _expected(fit: rigid.RigidFit, r: int):
    """Sufficient statistics of a batch as integers of 1e-9, so that their sum does
    not depend on how rows are dealt: rows (kind, k, n, w0, w1, w2)."""
    with np.errstate(divide="ignore"):
        log_pi, log_a = np.log(fit.pi), np.log(fit.A)
    whole = lambda x: np.rint(x * NANO).astype(np.int64)

    def kernel(batch):
        rows = []
        for k, n, _, psi, sums, length, inside, at in _rigid_groups(batch, fit, r):
            fwd = rigid.forward(log_pi, log_a, psi, sums, length, r)
            bwd = rigid.backward(log_a, psi, sums, length, r)
            moves, share = rigid.expectations(fwd, bwd, log_a, psi, sums, length, r)
            for i, m in enumerate(whole(moves).sum(axis=2)):
                rows.append((0, i, 0, *m.tolist()))
            rows.append((1, 0, len(length), *whole(share[0]).sum(axis=1).tolist()))
            w = whole(share.transpose(0, 2, 1)[inside])
            kk, nn = k[at[inside]], n[at[inside]]
            width = int(nn.max()) + 1
            key, place = np.unique(nn * width + kk, return_inverse=True)
            total = np.zeros((len(key), 3), np.int64)
            np.add.at(total, place, w)
            rows += [(2, int(x % width), int(x // width), *t) for x, t in zip(key, total.tolist())]
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kind", "k", "n", "w0", "w1", "w2"])

    return kernel


def _sums(rows: DataFrame, kernel) -> dict:
    from .blocks import whole_units

    def run(batches):
        for b in whole_units(batches, CHAIN):
            yield kernel(b)

    out = rows.mapInArrow(run, "kind long, k long, n long, w0 long, w1 long, w2 long")
    total = [F.sum(F.col(f"w{s}").cast("decimal(38,0)")).alias(f"w{s}") for s in range(3)]
    # groups: distinct (depth, count) pairs, bounded by the square of the depth
    keys = [F.when(F.col("kind") == 1, 0).otherwise(F.col("n")).alias("n")]
    got = out.groupBy("kind", "k", *keys).agg(*total, F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("chains")).collect()
    return {(r.kind, r.k, r.n): ([float(r.w0) / NANO, float(r.w1) / NANO, float(r.w2) / NANO], r.chains) for r in got}


def fit_rtiger(data: DataFrame, rigidity: int = 5, seed: int = 1, eps: float = 0.01, max_iter: int = 50, init: tuple | None = None, min_reads: int = 1) -> rigid.RigidFit:
    """Pooled EM over every chain of the cohort: one Spark job a round gathers exact
    sums over distinct (count, depth) pairs; the small maximisation is the driver's.
    The result does not depend on the number of partitions."""
    require(data, (*CHAIN, "pos", "n_ref", "n_alt"), "fit_rtiger")
    data = with_donor(data.where(F.col("n_ref") + F.col("n_alt") >= min_reads), None)
    check_coverage(data, rigidity)
    chains = _prepared_chains(data)
    try:
        return _em(chains, rigidity, init or rigid.initial(seed=seed), eps, max_iter)
    finally:
        chains.unpersist()


def _em(chains: DataFrame, r: int, init, eps: float, max_iter: int) -> rigid.RigidFit:
    fit = rigid.first_fit(*init)
    for done in range(1, max_iter + 1):
        got = _sums(chains, _expected(fit, r))
        pairs = sorted((n, k) for kind, k, n in got if kind == 2)
        if not pairs:
            raise NoData("rtiger: no covered markers")
        w = np.array([got[2, k, n][0] for n, k in pairs])
        ns, ks = (np.array(x, float) for x in zip(*pairs))
        moves = np.array([got[0, i, 0][0] for i in range(3)])
        total = moves.sum(axis=1, keepdims=True)
        start, count = got[1, 0, 0]
        new = [rigid.updated_state(ks, ns, w[:, s], float(ks @ w[:, s]), float(ns @ w[:, s]), fit.alpha[s], fit.beta[s]) for s in range(3)]
        alpha, beta = np.array(new).T
        moved = max(np.abs(alpha - fit.alpha).max(), np.abs(beta - fit.beta).max())
        fit = rigid.RigidFit(moves / np.where(total == 0, 1, total), np.array(start) / count, alpha, beta, done)
        if np.floor(moved * 1e6 + 0.5) / 1e6 <= eps:
            break
    return fit


def log_likelihood(data: DataFrame, fit: rigid.RigidFit, rigidity: int) -> float:
    """Total over chains, summed as integers of 1e-6."""
    with np.errstate(divide="ignore"):
        log_pi, log_a = np.log(fit.pi), np.log(fit.A)

    def kernel(batch):
        total = 0
        for _, _, _, psi, sums, length, _, _ in _rigid_groups(batch, fit, rigidity):
            fwd, bwd = rigid.forward(log_pi, log_a, psi, sums, length, rigidity), rigid.backward(log_a, psi, sums, length, rigidity)
            x = fwd[rigidity - 1] + bwd[rigidity - 1]
            top = x.max(axis=0)
            total += int(np.rint((top + np.log(np.exp(x - top).sum(axis=0))) * 1e6).sum())
        return pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["ll"])

    rows = by_unit(with_donor(data, None), CHAIN, ["pos"], [*KEEP, "n_ref", "n_alt"], kernel, "ll long")
    return float(rows.agg(F.sum("ll")).first()[0] or 0) / 1e6


def fit_rtiger_multistart(data: DataFrame, rigidity: int = 5, starts: int = 6, sample: int = 50, probe_iter: int = 10, seed: int = 1, **control) -> rigid.RigidFit:
    """Probes several starts on the first ``sample`` samples by name and fits the
    cohort from the most likely one's parameters."""
    names = data.select("name").distinct().orderBy("name").limit(sample)
    part = data.join(F.broadcast(names), "name", "left_semi")
    u = iter(rigid.uniforms(seed, 6 * starts))
    inits = [(np.array([20.0, 20, 1]), np.array([1.0, 20, 20]))]
    for _ in range(starts - 1):
        mean = np.array([0.90 + 0.09 * next(u), 0.30 + 0.40 * next(u), 0.02 + 0.18 * next(u)])
        tau = np.array([5 + 25 * next(u) for _ in range(3)])
        inits.append((tau * mean, tau * (1 - mean)))
    fits = [fit_rtiger(part, rigidity, max_iter=probe_iter, init=i) for i in inits]
    best = max(fits, key=lambda f: log_likelihood(part, f, rigidity))
    return fit_rtiger(data, rigidity, init=(best.alpha, best.beta), **control)


def _rigid_states(batch, fit: rigid.RigidFit, r: int, postprocess: bool) -> np.ndarray:
    with np.errstate(divide="ignore"):
        log_pi, log_a = np.log(fit.pi), np.log(fit.A)
    out = np.zeros(len(batch), np.int32)
    for _, _, logs, psi, sums, length, inside, at in _rigid_groups(batch, fit, r):
        path = rigid.paths(log_pi, log_a, psi, sums, length, r)
        for c, n in enumerate(length):
            p = path[:n, c]
            out[at[:n, c]] = rigid.replaced_borders(p, logs[at[:n, c]]) if postprocess else p
    return out


# ---------------------------------------------------------------- bins


def _binned(data: DataFrame, bin_size: int, donor) -> DataFrame:
    if "alt_freq" in data.columns:
        require(data, ("name", "chr", "pos", "start_bp", "end_bp"), "binhmm: bins made before")
        ninf = F.col("ninf") if "ninf" in data.columns else F.lit(1)
        out = with_donor(data, donor).select("donor", "name", "chr", F.col("pos").cast("long").alias("pos"), F.col("start_bp").cast("long").alias("start_bp"), F.col("end_bp").cast("long").alias("end_bp"), F.col("alt_freq").cast("double").alias("alt_freq"), ninf.cast("long").alias("ninf"))
    else:
        require(data, ("name", "chr", "pos", "n_ref", "n_alt"), "binhmm")
        out = bin_counts(with_donor(data, donor), bin_size).select("donor", "name", "chr", F.col("bin").alias("pos"), "start_bp", "end_bp", "alt_freq", "ninf")
    return out.where("ninf >= 1")


def _bin_states(data: DataFrame, bin_size, method, priors, donor, joint, weighted) -> DataFrame:
    if method not in ("gauss", "gmm", "kmeans", "rebmix"):
        raise ValueError("cluster_method must be gauss, gmm, kmeans or rebmix")
    if method == "rebmix":
        raise RuntimeError("cluster_method 'rebmix': backend not available; use gauss, gmm or kmeans")
    if weighted and joint and method == "kmeans":
        raise ValueError("kmeans takes no observation weights; use gmm")
    if method == "gauss" and (joint or weighted):
        warnings.warn("binhmm: joint_clust and obs_weights do not apply to gauss; ignored", stacklevel=3)
    if weighted and not joint and method != "gauss":
        warnings.warn("binhmm: obs_weights applies only to joint_clust; ignored", stacklevel=3)
    rows, start = _binned(data, bin_size, donor), np.array([1 - sum(priors), *priors])
    cols = ["donor", "name", "chr", "pos", "start_bp", "end_bp"]
    schema = "donor string, name string, chr int, pos long, start_bp long, end_bp long, state int"
    pooled = joint and method != "gauss"
    value = ["alt_freq", "ninf"]
    if pooled:
        rows = _pooled_labels(rows, method, weighted)
        value = ["label"]

    def kernel(batch):
        bounds = unit_bounds(batch, ["name"])
        chrom = column(batch, "chr")
        if method == "gauss":
            state = bins.gaussian_batch(column(batch, "alt_freq"), chrom, bounds, start)
        elif pooled:
            state = bins.smooth_batch(column(batch, "label"), chrom, bounds, start)
        else:
            share, n, labels = column(batch, "alt_freq"), column(batch, "ninf"), np.zeros(len(batch), np.int64)
            for i, j in zip(bounds[:-1], bounds[1:]):
                labels[i:j] = bins.cluster_states(np.clip(share[i:j] * (n[i:j] / n[i:j].mean()), 0, 1), method)
            state = bins.smooth_batch(labels, chrom, bounds, start)
        return append(batch, cols, state=pa.array(state, pa.int32()))

    return by_unit(rows, ["name"], ["chr", "pos"], [*cols, *value], kernel, schema)


def _pooled_labels(rows: DataFrame, method: str, weighted: bool) -> DataFrame:
    """One clustering of all samples' bins. The fit reads distinct shares with the bins
    and the weight they stand for: shares are ratios of small counts, so there are far
    fewer than bins; past a million of them, cells of 1e-6 stand for their shares."""
    w = F.col("ninf").cast("double") if weighted else F.lit(1.0)
    exact = rows.where("alt_freq > 0").agg(F.approx_count_distinct("alt_freq").alias("n")).first().n <= 1_000_000
    rows = rows.withColumn("__share", F.col("alt_freq") if exact else F.when(F.col("alt_freq") > 0, F.greatest(F.round("alt_freq", 6), F.lit(1e-6))).otherwise(F.lit(0.0)))
    pairs = rows.where("alt_freq > 0").groupBy("__share").agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n")).orderBy("__share").toPandas()
    if not len(pairs):
        return rows.withColumn("label", F.lit(0))
    share, weight, n = (pairs[c].to_numpy(float) for c in ("__share", "w", "n"))
    states = bins.cluster_states(share, method, weight if weighted else None, n)
    names = rows.sparkSession.createDataFrame([(float(s), int(k)) for s, k in zip(share, states)], "__share double, label int")
    return rows.join(names, "__share", "left").withColumn("label", F.coalesce("label", F.lit(0)))


# ---------------------------------------------------------------- families


def _family_states(data: DataFrame, p_het: float, route: str, min_gametes: int = 200, rounds: int = 50) -> DataFrame:
    """One unit is a family's chromosome; the model pools it, so it is one task's."""

    def kernel(batch):
        out = []
        bounds = unit_bounds(batch, ["family", "chr"])
        for i, j in zip(bounds[:-1], bounds[1:]):
            unit = batch.slice(i, j - i)
            names, taxon = np.unique(column(unit, "name").astype(str), return_inverse=True)
            sites, site = np.unique(column(unit, "pos"), return_inverse=True)
            if len(names) < 2 or len(sites) < 2:
                continue
            g = np.full((len(names), len(sites)), haplotypes.MISSING)
            g[taxon, site] = column(unit, "g")
            call = haplotypes.call_biparental if route == "biparental" else haplotypes.call_backcross
            h, kept, taxa = call(g, sites, min_gametes=min_gametes)
            if not len(kept) or not len(taxa):
                continue
            state = haplotypes.fill_gaps(fivestate.impute(h, sites[kept], p_het, rounds)[0])
            t, s = np.nonzero(state != haplotypes.MISSING)
            donors = dict(zip(column(unit, "name").astype(str)[::-1], unit.column(unit.schema.get_field_index("donor")).to_pylist()[::-1]))
            labels = names[taxa[t]]
            out.append(pa.RecordBatch.from_arrays(
                [pa.array([donors[x] for x in labels], pa.string()), pa.array(labels, pa.string()), pa.array(np.full(len(t), column(unit, "chr")[0]), pa.int32()), pa.array(sites[kept[s]], pa.int64()), pa.array(state[t, s], pa.int32())],
                names=["donor", "name", "chr", "pos", "state"],
            ))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return by_unit(data, ["family", "chr"], ["name", "pos"], [*KEEP, "g"], kernel, STATE_SCHEMA)


def family_pedigree(pedigree: DataFrame) -> dict[str, tuple[list[str], list[str | None]]]:
    """family -> (taxa, parents). A pedigree has a row per line, far fewer than
    observations; its wiring is checked before any data is read."""
    require(pedigree, ("taxon", "family", "parent1"), "pedigree")
    found: dict[str, tuple[list, list]] = {}
    for r in pedigree.select("family", "taxon", "parent1").orderBy("family", "taxon").collect():
        taxa, parents = found.setdefault(r.family, ([], []))
        if r.taxon not in taxa:
            taxa.append(r.taxon)
            parents.append(r.parent1)
    for fam, (taxa, parents) in found.items():
        try:
            belief.tree(taxa, parents)
        except ValueError as e:
            raise ValueError(f"family {fam!r}: {e}") from None
    return found


def _pedigree_states(data: DataFrame, pedigree: DataFrame, design: str, emission, rrate: float, rounds: int, tol: float, damping: float) -> DataFrame:
    families = family_pedigree(pedigree)
    prior, n_bc = designs.founder_prior(design), designs.parse_design(design)[0]
    members = pedigree.select(F.col("taxon").alias("name"), F.col("family").alias("family")).distinct()
    value = ["state"] if isinstance(emission, GenotypeEmission) else ["n_ref", "n_alt"]
    use_cm = "cm" in data.columns
    rows = data.drop("family").join(F.broadcast(members), "name")  # bounded by the pedigree, which the driver holds as well
    cols = [*KEEP, *value, *(["cm"] if use_cm else [])]

    def kernel(batch):
        out = []
        bounds = unit_bounds(batch, ["family", "chr"])
        for i, j in zip(bounds[:-1], bounds[1:]):
            unit = batch.slice(i, j - i)
            taxa, parents = families[unit.column(unit.schema.get_field_index("family"))[0].as_py()]
            up, depth, root = belief.tree(taxa, parents)
            sites, first, site = np.unique(column(unit, "pos"), return_index=True, return_inverse=True)
            cm = column(unit, "cm").astype(float)[first] if use_cm else None
            labels, row_taxon = np.unique(column(unit, "name").astype(str), return_inverse=True)
            number = {t: v for v, t in reversed(list(enumerate(taxa)))}
            row_taxon = np.array([number[x] for x in labels])[row_taxon]
            # rows of a taxon together, in order of their sites; of one site the first counts
            order = np.lexsort((site, row_taxon))
            first_of = np.append(True, (np.diff(row_taxon[order]) != 0) | (np.diff(site[order]) != 0))
            own, seen = np.split(order, np.searchsorted(row_taxon[order], np.arange(1, len(taxa)))), [None] * len(taxa)
            if isinstance(emission, GenotypeEmission):
                known = column(unit, "state").astype(float)
                likelihood = emission.matrix().T[np.where(np.isnan(known), 3, known).astype(int)]
            else:
                likelihood = np.exp(count_emission(column(unit, "n_ref").astype(np.int64), column(unit, "n_alt").astype(np.int64), emission))
            single = np.zeros(len(unit), bool)
            single[order[first_of]] = True
            for v, at in enumerate(own):
                at = at[single[at]]
                seen[v] = (site[at], likelihood[at]) if len(at) else None
            uniform = np.full(3, 1 / 3)
            start = [prior if v == root else uniform for v in range(len(taxa))]
            fam = belief.Family(up, [n_bc + 1 + d for d in depth], seen, start, start, belief.interval_rates(sites, cm, rrate))
            fam.run(rounds, tol, damping)
            states = np.zeros(len(unit), np.int32)
            for v, called in fam.states():
                states[own[v]] = called[site[own[v]]]
            out.append(append(unit, KEEP, state=pa.array(states, pa.int32())))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    # a number of tasks by families: their work is long, however few their rows are
    return by_unit(rows, ["family", "chr"], ["pos", "name"], cols, kernel, STATE_SCHEMA, max(1, min(MOST_TASKS, 16 * len(families))))


def refine_ancestry(mosaic: DataFrame, pedigree: DataFrame, design: str = "BC2S3", emission: str = "gt", err: float | None = None, gert: float = 0.10, conc: float = 20.0, rrate: float = 0.01, maxiter: int = 30, tol: float = 1e-4, damping: float = 0.5) -> DataFrame:
    """``mosaic`` rows of pedigreed samples, with the state refined by their family;
    all other columns stay as they are."""
    if emission not in ("gt", "count"):
        raise ValueError("refine_ancestry: emission must be 'gt' or 'count'")
    require(mosaic, (*CHAIN, "pos", *(("state",) if emission == "gt" else ("n_ref", "n_alt"))), "refine_ancestry")
    spec = GenotypeEmission(germ=0.05 if err is None else err, gert=gert) if emission == "gt" else CountEmission(0.01 if err is None else err, conc)
    states = _pedigree_states(with_donor(mosaic, None), pedigree, design, spec, rrate, maxiter, tol, damping)
    new = states.select("name", "chr", "pos", F.col("state").alias("__state")).distinct()
    out = mosaic.join(new, ["name", "chr", "pos"]).withColumn("state", F.col("__state"))
    return out.select(*dict.fromkeys([*mosaic.columns, "state"]))


# ---------------------------------------------------------------- verbs


def call_states(
    data: DataFrame, caller: str = "bbnil", *, design=None, f_1=None, f_2=None, rrate=0.01, rigidity=None, err=0.01, conc=20.0, fit_means=False, xrate=0.01,
    germ=0.05, gert=0.10, p=0.5, mr=0.10, nir=0.01, min_reads=1, bin_size=1_000_000, cluster_method="gauss", joint_clust=False, obs_weights=False,
    atlas_thresh=0.95, atlas_het=0.25, atlas_min_reads=5, genotypeerr=0.05, recombdist=None, drp=False, unit="bp", phet=None, pedigree=None,
    ped_maxiter=30, ped_tol=1e-4, ped_lambda=0.5, seed=1, postprocess=True, fit=None, precision="fixed", source=DEFAULT_SOURCE, donor=None, **ignored,
) -> DataFrame:
    """Ancestry states (source, donor, name, chr, pos, state) of every marker; bins
    carry start_bp and end_bp too. Lazy; ``threads``, ``parallel`` and such are taken
    and ignored, Spark deals the work."""
    if caller not in CALLERS:
        raise ValueError(f"caller must be one of {', '.join(CALLERS)}; got {caller!r}")
    if unknown := set(ignored) - {"threads", "parallel", "family"}:
        raise TypeError(f"call_states: unknown argument(s) {', '.join(sorted(unknown))}")
    require(data, (*CHAIN, "pos"), "call_states")
    counts, exact = has(data, "n_ref", "n_alt"), precision == "fixed"
    rows = with_donor(data, donor)

    if caller == "fsfhap":
        require(data, ("g",), "call_states: fsfhap")
        require(data, ("family",), "call_states: fsfhap")
        if phet is None:
            if design is None:
                raise ValueError("call_states: fsfhap needs `design` or `phet`")
            phet = designs.expected_het(1 - 0.5 ** designs.parse_design(design)[1])
        route = "biparental" if design is not None and designs.parse_design(design)[0] != 1 else "bc"
        return _state_frame(_family_states(rows, phet, route), source)
    if caller == "pedigree":
        if pedigree is None or design is None:
            raise ValueError("call_states: pedigree needs `pedigree` and `design`")
        if not counts and "state" not in data.columns:
            require(data, ("g",), "call_states: pedigree (n_ref and n_alt, state, or g)")
            rows = rows.withColumn("state", F.col("g").cast("int"))
        spec = CountEmission(err, conc) if counts else GenotypeEmission(germ=germ, gert=gert)
        return _state_frame(_pedigree_states(rows, pedigree, design, spec, rrate, ped_maxiter, ped_tol, ped_lambda), source)
    if caller in ("nnil", "catiger"):
        require(data, ("g",), f"call_states: {caller} does not threshold counts; it")
    elif caller == "binhmm":
        if "alt_freq" not in data.columns and not counts:
            raise SchemaError("call_states: binhmm needs n_ref and n_alt, or alt_freq")
    elif not counts:
        raise SchemaError(f"call_states: {caller} needs n_ref and n_alt")
    priors = designs.state_frequencies(design, f_1, f_2) if caller not in ("rtiger", "lbimpute") else None

    if caller == "binhmm":
        return _state_frame(_bin_states(data, bin_size, cluster_method, priors, donor, joint_clust, obs_weights), source)
    if caller == "lbimpute":
        recombdist = (50.0 if unit == "cm" else 1e7) if recombdist is None else recombdist
        at = _coordinate(data, unit, recombdist, "call_states")
        start = _start(design, f_1, f_2)

        def lb(batch):
            logs = low_coverage_emission(column(batch, "n_ref").astype(np.int64), column(batch, "n_alt").astype(np.int64), err, genotypeerr)
            state = _distance_states(unit_bounds(batch, CHAIN), logs, column(batch, "__at"), start, float(recombdist), drp, exact)
            return append(batch, KEEP, state=pa.array(state, pa.int32()))

        return _state_frame(by_unit(_checked_coordinate(rows, at), CHAIN, ["pos"], [*KEEP, "n_ref", "n_alt", "__at"], lb, STATE_SCHEMA), source)

    if caller in ("nnil", "catiger"):
        rows = rows.where("g <> 3")
    elif caller in ("bbnil", "rtiger") and min_reads:
        rows = rows.where(F.col("n_ref") + F.col("n_alt") >= min_reads)
    if caller == "rtiger":
        r = 5 if rigidity is None else int(rigidity)
        check_coverage(rows, r)
        fitted = fit or fit_rtiger(rows, r, seed, min_reads=0)

        def decode(batch):
            return append(batch, KEEP, state=pa.array(_rigid_states(batch, fitted, r, postprocess), pa.int32()))

        return _state_frame(by_unit(rows, CHAIN, ["pos"], [*KEEP, "n_ref", "n_alt"], decode, STATE_SCHEMA), source)
    if caller in ("googa", "atlas"):
        rows = rows.withColumn("g", hard_call(F.col("n_alt"), F.col("n_ref") + F.col("n_alt"), atlas_thresh, atlas_het, atlas_min_reads))
    emission, duration = caller_spec(caller, rrate, rigidity, err, conc, fit_means, xrate, germ, gert, p, mr, nir)
    return _grid_states(rows, emission, duration, priors, source, exact)


def call_ancestry(data: DataFrame, caller: str = "bbnil", **params) -> DataFrame:
    """Ancestry segments: states, then runs of them."""
    return to_segments(call_states(data, caller, **params), params.get("source", DEFAULT_SOURCE))


def caller_sweep(
    data: DataFrame, caller: str, values, *, refit="none", design=None, f_1=None, f_2=None, ref=None, min_reads=1, err=0.01, conc=20.0, fit_means=False, seed=1,
    postprocess=True, unit="bp", genotypeerr=0.05, drp=False, source=DEFAULT_SOURCE, donor=None, precision="fixed", **ignored,
) -> DataFrame:
    """Segments for every value of the caller's parameter (rrate, rigidity or
    recombdist, which is added as a column). Values are an axis inside the kernel:
    rows are clustered and emissions computed once, and only segments leave it."""
    name = {"nnil": "rrate", "bbnil": "rrate", "rtiger": "rigidity", "lbimpute": "recombdist"}.get(caller)
    if name is None:
        raise ValueError("caller_sweep: caller must be nnil, bbnil, rtiger or lbimpute")
    if refit not in ("none", "cold"):
        raise ValueError("caller_sweep: refit must be 'none' or 'cold'")
    values = [int(v) if caller == "rtiger" else float(v) for v in values]
    if not values:
        raise ValueError("caller_sweep: `values` is empty")
    require(data, (*CHAIN, "pos"), "caller_sweep")
    if caller == "nnil":
        require(data, ("g",), "caller_sweep: nnil")
        if has(data, "n_ref", "n_alt"):
            warnings.warn("caller_sweep: nnil reads `g`; n_ref and n_alt are ignored", stacklevel=2)
    else:
        require(data, ("n_ref", "n_alt"), f"caller_sweep: {caller}")
    rows, exact = with_donor(data, donor), precision == "fixed"
    kind = "int" if caller == "rtiger" else "double"

    def segmented(batch, bounds, states) -> pa.RecordBatch:
        parts = []
        for v, state in zip(values, states):
            seg = runs(batch, CHAIN, state, source)
            parts.append(pa.RecordBatch.from_arrays([*seg.columns, pa.array(np.full(len(seg), v), pa.int32() if kind == "int" else pa.float64())], names=[*seg.schema.names, name]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    schema = f"{SEGMENT_SCHEMA}, {name} {kind}"
    middle = float(np.median(values)) if ref is None else float(ref)
    if caller == "lbimpute":
        at, start = _coordinate(data, unit, values, "caller_sweep"), _start(design, f_1, f_2)

        def lb(batch):
            bounds, x = unit_bounds(batch, CHAIN), column(batch, "__at")
            logs = low_coverage_emission(column(batch, "n_ref").astype(np.int64), column(batch, "n_alt").astype(np.int64), err, genotypeerr)
            return segmented(batch, bounds, [_distance_states(bounds, logs, x, start, v, drp, exact) for v in values])

        return by_unit(_checked_coordinate(rows, at), CHAIN, ["pos"], [*KEEP, "n_ref", "n_alt", "__at"], lb, schema)
    if caller != "nnil" and min_reads:
        rows = rows.where(F.col("n_ref") + F.col("n_alt") >= min_reads)
    if caller == "rtiger":
        check_coverage(rows, max(values))
        shared = None if refit == "cold" else fit_rtiger(rows, int(round(middle)), seed, min_reads=0)
        fits = [shared or fit_rtiger(rows, v, seed, min_reads=0) for v in values]

        def decode(batch):
            return segmented(batch, None, [_rigid_states(batch, f, v, postprocess) for f, v in zip(fits, values)])

        return by_unit(rows, CHAIN, ["pos"], [*KEEP, "n_ref", "n_alt"], decode, schema)
    priors = designs.state_frequencies(design, f_1, f_2)
    chains = [transition(caller_spec(caller, rrate=v)[1], *priors) for v in values]
    emission = caller_spec(caller, middle, err=err, conc=conc, fit_means=fit_means)[0]
    if caller == "nnil" or not fit_means:

        def finish(batch, bounds, logs, last_ties):
            return segmented(batch, bounds, [decode_logs(bounds, logs, c, last_ties, exact) for c in chains])

        kernel = _grid_kernel(emission, chains[0], chains[0], exact, finish)
        return by_unit(rows, CHAIN, ["pos"], [*KEEP, *(["g"] if caller == "nnil" else ["n_ref", "n_alt"])], kernel, schema)
    at_ref = transition(caller_spec(caller, rrate=middle)[1], *priors)

    def fitted(batch):
        bounds, sample = unit_bounds(batch, CHAIN), unit_bounds(batch, ["name"])
        r, a = column(batch, "n_ref").astype(np.int64), column(batch, "n_alt").astype(np.int64)
        states = [np.zeros(len(batch), np.int32) for _ in values]
        for i, j in zip(sample[:-1], sample[1:]):
            inner = bounds[(bounds >= i) & (bounds <= j)]
            obs = [((r + a)[x:y], a[x:y]) for x, y in zip(inner[:-1], inner[1:])]
            shared = fit_theta(obs, emission, at_ref) if refit == "none" else None
            for k, c in enumerate(chains):
                theta = shared or fit_theta(obs, emission, c)
                states[k][i:j] = decode_logs(inner - i, count_emission(r[i:j], a[i:j], emission, theta), c, False, exact)
        return segmented(batch, bounds, states)

    return by_unit(rows, ["name"], ["chr", "pos"], [*KEEP, "n_ref", "n_alt"], fitted, schema)


def fit_model(obs: list[tuple[int, int]] | np.ndarray, emission, duration, priors: tuple[float, float], control: dict | None = None):
    """(theta or None, transition) of one chain of (depth, alt) observations."""
    chain = transition(duration, *priors)
    if not isinstance(emission, CountEmission):
        return None, chain
    theta = emission.theta
    if emission.fit_means:
        x = np.asarray(obs, np.int64).reshape(-1, 2)
        control = control or {}
        theta = fit_theta([(x[:, 0], x[:, 1])], emission, _collapsed(duration, *priors), rounds=control.get("max_iter", 100), tol=control.get("tol", 1e-5))
    return theta, chain


def decode(model, obs, emission, exact: bool = True) -> np.ndarray:
    """Best states of one chain: obs are (depth, alt) pairs, or calls 0..3."""
    theta, chain = model
    if isinstance(emission, GenotypeEmission):
        logs = genotype_emission(np.asarray(obs, np.int64), emission)
    else:
        x = np.asarray(obs, np.int64).reshape(-1, 2)
        logs = count_emission(x[:, 0] - x[:, 1], x[:, 1], emission, theta)
    return decode_logs(np.array([0, len(logs)]), logs, chain, isinstance(emission, GenotypeEmission), exact)


fit = fit_model
