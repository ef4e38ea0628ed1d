"""The two axes of a caller: how reads or calls speak (emission) and how long a
state lasts (duration). Both are plain values; new kinds plug in by a dataclass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class CountEmission:
    """Beta-binomial read counts around the mean alternative fraction of a state."""

    err: float = 0.01
    conc: float = 20.0
    fit_means: bool = False

    @property
    def theta(self) -> tuple[float, float, float]:
        return self.err, 0.5, 1 - self.err


@dataclass(frozen=True)
class GenotypeEmission:
    """Categorical calls 0, 1, 2, 3 (missing) with genotyping error rates."""

    germ: float = 0.05
    gert: float = 0.10
    p: float = 0.5
    mr: float = 0.10
    nir: float = 0.01

    def matrix(self) -> np.ndarray:
        """P(call | state), rows REF, HET, ALT. A state's call is the error model of
        its own genotype, but for a share ``nir`` of uninformative sites, where the
        recurrent genotype's model shows."""
        hom, het, seen = self.germ, self.gert, 1 - self.mr
        as_ref = np.array([1 - hom, self.p * hom, (1 - self.p) * hom])
        ref = as_ref
        of_het = np.array([0.5 * het, 1 - het, 0.5 * het])
        of_alt = np.array([(1 - self.p) * hom, self.p * hom, 1 - hom])
        mix = lambda own: (1 - self.nir) * own + self.nir * as_ref
        rows = np.stack([ref, mix(of_het), mix(of_alt)]) * seen
        return np.column_stack([rows, np.full(3, self.mr)])


@dataclass(frozen=True)
class GeometricDuration:
    """Memoryless: leave a state with probability ``r`` a step."""

    r: float = 0.01


@dataclass(frozen=True)
class RigidDuration:
    """At least ``r`` steps in a state, then leave with probability ``p_switch``."""

    r: int = 5
    p_switch: float = 0.01

    def __post_init__(self) -> None:
        if self.r < 1:
            raise ValueError("rigidity must be >= 1")


@dataclass(frozen=True)
class SemiMarkovDuration:
    """Reserved; no decoder takes it."""

    sojourn: object = None


emission_count, emission_gt = CountEmission, GenotypeEmission


def duration_geometric(rrate: float = 0.01) -> GeometricDuration:
    return GeometricDuration(rrate)


def duration_rigidity(rigidity: int = 5, xrate: float = 0.01) -> RigidDuration:
    return RigidDuration(int(rigidity), xrate)


def duration_hsmm(sojourn=None) -> SemiMarkovDuration:
    return SemiMarkovDuration(sojourn)


def select_emission(depth: float) -> CountEmission | GenotypeEmission:
    """Saturated sites have hard calls; below that the counts speak."""
    return GenotypeEmission() if depth >= 20 else CountEmission()


#: Grid callers: (emission kind, duration kind).
GRID = {
    "nnil": ("gt", "geometric"), "googa": ("gt", "geometric"), "bbnil": ("count", "geometric"),
    "catiger": ("gt", "rigid"), "atlas": ("gt", "rigid"), "rtiger": ("count", "rigid"),
}


def caller_spec(caller: str = "nnil", rrate=0.01, rigidity=None, err=0.01, conc=20.0, fit_means=False, xrate=0.01, germ=0.05, gert=0.10, p=0.5, mr=0.10, nir=0.01, **_):
    """(emission, duration) of a grid caller."""
    if caller not in GRID:
        raise ValueError(f"caller must be one of {', '.join(GRID)}; got {caller!r}")
    emission, duration = GRID[caller]
    return (
        GenotypeEmission(germ, gert, p, mr, nir) if emission == "gt" else CountEmission(err, conc, fit_means),
        GeometricDuration(rrate) if duration == "geometric" else RigidDuration(5 if rigidity is None else int(rigidity), xrate),
    )


@dataclass(frozen=True)
class Transition:
    """Macro-state chain: start and step probabilities and the minimum run."""

    start: np.ndarray
    step: np.ndarray
    rigid: int = 1


def transition(duration, f_1: float, f_2: float) -> Transition:
    """Stay with 1 - r; a leaving step picks the other states by their frequency."""
    if isinstance(duration, SemiMarkovDuration) or not hasattr(duration, "r"):
        raise NotImplementedError("this duration has no decoder: hsmm is reserved")
    freq = np.array([1 - f_1 - f_2, f_1, f_2])
    if freq[0] <= 0:
        raise ValueError("f_1 + f_2 must be < 1")
    leave = duration.r if isinstance(duration, GeometricDuration) else duration.p_switch
    step = leave * freq[None, :] / (freq.sum() - freq)[:, None]
    np.fill_diagonal(step, 1 - leave)
    return Transition(freq, step, duration.r if isinstance(duration, RigidDuration) else 1)

