"""Breeding designs: expected single-locus genotype frequencies and priors."""

from __future__ import annotations

import re

import numpy as np

#: Genotype transition of one backcross to the recurrent parent and of one selfing,
#: rows and columns (recurrent homozygote, heterozygote, donor homozygote).
BACKCROSS = np.array([[1, 0, 0], [0.5, 0.5, 0], [0, 1, 0]])
SELFING = np.array([[1, 0, 0], [0.25, 0.5, 0.25], [0, 0, 1]])


def parse_design(design: str) -> tuple[int, int]:
    """(backcrosses, selfings) of 'BC<n>S<m>'."""
    m = re.fullmatch(r"BC(\d+)S(\d+)", design or "")
    if not m:
        raise ValueError(f"design must be 'BC<n>S<m>' (such as BC2S3), got {design!r}")
    return int(m[1]), int(m[2])


def single_locus_expectation(design: str, f1=(0.0, 1.0, 0.0)) -> dict[str, float]:
    """Expected REF, HET and ALT frequencies after the design, from an F1."""
    n_bc, n_self = parse_design(design)
    v = np.asarray(f1, float) @ np.linalg.matrix_power(BACKCROSS, n_bc) @ np.linalg.matrix_power(SELFING, n_self)
    return dict(zip(("REF", "HET", "ALT"), v.tolist()))


def breeding_prior(design: str, f1=(0.0, 1.0, 0.0)) -> dict[str, float]:
    return single_locus_expectation(design, f1)


def state_frequencies(design: str | None = None, f_1: float | None = None, f_2: float | None = None) -> tuple[float, float]:
    """(HET, ALT) frequency; a design wins over explicit numbers."""
    if design is not None:
        p = breeding_prior(design)
        return p["HET"], p["ALT"]
    if f_1 is None or f_2 is None:
        raise ValueError("supply `design` or both `f_1` and `f_2`")
    if f_1 + f_2 >= 1:
        raise ValueError("`f_1` + `f_2` must be < 1")
    return f_1, f_2


def founder_prior(design: str) -> np.ndarray:
    """A backcross founder carries all donor content as heterozygous."""
    p = breeding_prior(design)
    q = p["ALT"] + p["HET"] / 2
    return np.array([1 - 2 * q, 2 * q, 0.0])


def expected_het(inbreeding: float | None, default: float = 0.07) -> float:
    """Heterozygosity (1 - F) / 2 of an inbreeding coefficient in [0, 1]."""
    ok = inbreeding is not None and inbreeding == inbreeding and 0 <= inbreeding <= 1
    return (1 - inbreeding) / 2 if ok else default


def expected_fragment_dist(design: str):
    raise NotImplementedError("expected_fragment_dist is not yet implemented")


def fit_design_gamma(segments):
    raise NotImplementedError("fit_design_gamma is not yet implemented")
