"""Gametes under the Stahl model of crossover interference.

A chromosome's haplotype is (ends, alleles): allele k holds up to ends[k]."""

from __future__ import annotations

import numpy as np

Haplotype = tuple[np.ndarray, np.ndarray]


def founder(length: float, allele: int) -> Haplotype:
    return np.array([length]), np.array([allele])


def crossovers(length: float, rng: np.random.Generator, m: int = 10, p: float = 0.0) -> np.ndarray:
    """Places in cM. A share ``p`` of chiasmata is free; the others are every
    (m+1)-th point of a denser Poisson process; half of all reach a gamete."""
    points = np.sort(rng.uniform(0, length, rng.poisson(length / 50 * (m + 1) * (1 - p))))
    chiasmata = np.concatenate([points[rng.integers(0, m + 1) :: m + 1], rng.uniform(0, length, rng.poisson(length / 50 * p))])
    return np.sort(chiasmata[rng.random(len(chiasmata)) < 0.5])


def alleles_at(hap: Haplotype, x: np.ndarray) -> np.ndarray:
    """Allele at each place; a place on a border belongs to the left piece."""
    ends, alleles = hap
    return alleles[np.minimum(np.searchsorted(ends, x, "left"), len(alleles) - 1)]


def gamete(mother: Haplotype, father: Haplotype, rng: np.random.Generator, m: int = 10, p: float = 0.0) -> Haplotype:
    length = float(mother[0][-1])
    cuts = np.append(crossovers(length, rng, m, p), length)
    source, at = int(rng.integers(2)), 0.0
    ends, alleles = [], []
    for cut in cuts:
        e, a = (mother, father)[source]
        inner = (e > at) & (e < cut)
        for x, k in [*zip(e[inner], a[inner]), (cut, alleles_at((e, a), np.array([cut]))[0])]:
            if ends and alleles[-1] == k:
                ends[-1] = x
            elif x > at or not ends:
                ends.append(x)
                alleles.append(k)
        source, at = 1 - source, cut
    return np.array(ends), np.array(alleles)


def line(length: float, n_bc: int, n_self: int, rng: np.random.Generator, m: int = 10, p: float = 0.0) -> tuple[Haplotype, Haplotype]:
    """Both haplotypes of a line after backcrosses to parent 1 and selfings."""
    mother, father = founder(length, 1), founder(length, 2)
    for _ in range(n_bc):
        mother, father = founder(length, 1), gamete(mother, father, rng, m, p)
    for _ in range(n_self):
        mother, father = gamete(mother, father, rng, m, p), gamete(mother, father, rng, m, p)
    return mother, father
