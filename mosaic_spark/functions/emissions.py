"""Log-likelihoods of observations per state, as numpy arrays over distinct
observations and, where a query needs it, as Spark columns.

Decoders work on fixed-point logs (nano-nats in int64): sums of integers do not
depend on order or engine, so ties are ties everywhere."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .specs import CountEmission, GenotypeEmission

NANO = 1_000_000_000
#: Stands for log 0: far below any real path, far above int64 overflow.
IMPOSSIBLE = -(10**15)


def fixed(logs: np.ndarray) -> np.ndarray:
    """Nano-nats, halves away from zero as SQL rounds them."""
    with np.errstate(invalid="ignore"):
        x = np.asarray(logs, float) * NANO
        return np.where(np.isfinite(x), np.sign(x) * np.floor(np.abs(np.where(np.isfinite(x), x, 0)) + 0.5), IMPOSSIBLE).astype(np.int64)


def _lbeta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_binomial(n: int, a: int, alpha: float, beta: float) -> float:
    """log P(a of n), for a beta-binomial(alpha, beta)."""
    choose = math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n - a + 1)
    return choose + _lbeta(a + alpha, n - a + beta) - _lbeta(alpha, beta)


def count_logs(n, a, theta, conc: float) -> np.ndarray:
    """Rows of log P(a alternative of n reads | state); flat where n is 0."""
    if conc <= 0 or min(theta) <= 0 or max(theta) >= 1:
        raise ValueError("count emission needs 0 < theta < 1 and conc > 0")
    out = np.zeros((len(n), len(theta)))
    for i, (depth, alt) in enumerate(zip(n, a)):
        if not 0 <= alt <= depth:
            raise ValueError("count emission needs 0 <= n_alt <= depth")
        if depth:
            out[i] = [beta_binomial(int(depth), int(alt), t * conc, (1 - t) * conc) for t in theta]
    return out


def distinct_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (x, y) and each row's place among them: cohorts have few."""
    width = int(y.max()) + 1 if len(y) else 1
    key, at = np.unique(x.astype(np.int64) * width + y, return_inverse=True)
    return key // width, key % width, at


def count_emission(n_ref: np.ndarray, n_alt: np.ndarray, emission: CountEmission, theta=None) -> np.ndarray:
    n, a, at = distinct_pairs(n_ref.astype(np.int64) + n_alt, n_alt.astype(np.int64))
    return count_logs(n, a, theta or emission.theta, emission.conc)[at]


def genotype_emission(g: np.ndarray, emission: GenotypeEmission) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(emission.matrix().T)[g]


def low_coverage_emission(n_ref: np.ndarray, n_alt: np.ndarray, err: float, floor: float) -> np.ndarray:
    """Read likelihoods scaled into [floor, 1 - floor] by the best state, logged: no
    single site outweighs a genotyping error of ``floor``."""
    if not 0 < err < 0.5:
        raise ValueError("err must be in (0, 0.5)")
    if not 0 <= floor < 0.5:
        raise ValueError("genotypeerr must be in [0, 0.5)")
    r, a, at = distinct_pairs(n_ref, n_alt)
    ok, bad = math.log(1 - err), math.log(err)
    raw = np.column_stack([r * ok + a * bad, (r + a) * math.log(0.5), a * ok + r * bad])
    with np.errstate(divide="ignore"):
        return np.log(np.exp(raw - raw.max(axis=1, keepdims=True)) * (1 - 2 * floor) + floor)[at]


def hard_call(n_alt: Column, depth: Column, thresh: float = 0.95, het: float = 0.25, min_reads: int = 5) -> Column:
    """Genotype by the share of donor reads; 3 below ``min_reads`` and in between the
    bands. The heterozygous band is asked first, so it wins where bands overlap."""
    f = F.try_divide(n_alt.cast("double"), depth.cast("double"))
    call = F.when((f >= het) & (f <= 1 - het), 1).when(f >= thresh, 2).when(f <= 1 - thresh, 0).otherwise(3)
    return F.when((depth >= min_reads) & (depth > 0), call).otherwise(3).cast("int")


def hard_call_array(a: np.ndarray, n: np.ndarray, thresh=0.95, het=0.25, min_reads=5) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        f = a / n
    call = np.select([(f >= het) & (f <= 1 - het), f >= thresh, f <= 1 - thresh], [1, 2, 0], 3)
    return np.where((n >= min_reads) & (n > 0), call, 3)


def count_log_column(n: Column, a: Column, theta: float, conc: float) -> Column:
    """The count log-likelihood in Spark SQL, which has no log-gamma: rising
    factorials as sums of logs over a sequence. For distinct pairs, not for rows."""
    rising = lambda base, k: F.when(k > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + F.log(i + F.lit(base)))).otherwise(0.0)
    choose = rising(1.0, n) - rising(1.0, a) - rising(1.0, n - a)
    return choose + rising(theta * conc, a) + rising((1 - theta) * conc, n - a) - rising(conc, n)
