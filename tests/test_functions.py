import math

import numpy as np
import pytest

from mosaic_spark.functions import design, emissions, specs
from mosaic_spark.functions.genotype import call_gt
from mosaic_spark.kernels import rigid


def test_design_priors():
    assert [round(x, 4) for x in design.breeding_prior("BC2S3").values()] == [0.8594, 0.0312, 0.1094]
    assert design.single_locus_expectation("BC1S4") == {"REF": 0.734375, "HET": 0.03125, "ALT": 0.234375}
    assert design.parse_design("BC12S0") == (12, 0)
    for bad in ("BC2", "bc2s2", "BC2S2x", "", None):
        with pytest.raises(ValueError):
            design.parse_design(bad)
    with pytest.raises(ValueError):
        design.state_frequencies(None, 0.5, 0.5)
    with pytest.raises(ValueError):
        design.state_frequencies(None, 0.1, None)
    assert np.allclose(design.founder_prior("BC1S1"), [0.5, 0.5, 0])
    for stub in (design.expected_fragment_dist, design.fit_design_gamma):
        with pytest.raises(NotImplementedError):
            stub("BC1S1")


@pytest.mark.parametrize("f,expected", [(0.9375, 0.03125), (0.75, 0.125), (None, 0.07), (float("nan"), 0.07), (2, 0.07)])
def test_expected_het(f, expected):
    assert design.expected_het(f) == expected


def test_genotype_matrix_is_a_distribution():
    m = specs.GenotypeEmission(0.05, 0.1, 0.4, 0.2, 0.03).matrix()
    assert np.allclose(m.sum(axis=1), 1) and (m[:, 3] == 0.2).all()
    assert m[1, 0] == pytest.approx((0.97 * 0.05 + 0.03 * 0.95) * 0.8)


def test_specs():
    assert isinstance(specs.select_emission(20), specs.GenotypeEmission) and isinstance(specs.select_emission(19), specs.CountEmission)
    assert specs.caller_spec("rtiger", rigidity=7)[1] == specs.RigidDuration(7, 0.01)
    with pytest.raises(ValueError):
        specs.duration_rigidity(0)
    with pytest.raises(NotImplementedError):
        specs.transition(specs.duration_hsmm(), 0.1, 0.1)
    t = specs.transition(specs.duration_geometric(0.02), 0.1, 0.2)
    assert np.allclose(t.step.sum(axis=1), 1) and np.allclose(np.diag(t.step), 0.98)
    assert t.step[0, 1] == pytest.approx(0.02 / 3)


def test_count_emission_matches_the_definition():
    def lbeta(a, b):
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    got = emissions.count_logs([7], [2], (0.01, 0.5, 0.99), 20.0)[0]
    for x, t in zip(got, (0.01, 0.5, 0.99)):
        assert x == pytest.approx(math.log(math.comb(7, 2)) + lbeta(2 + 20 * t, 5 + 20 * (1 - t)) - lbeta(20 * t, 20 * (1 - t)))
    assert (emissions.count_logs([0], [0], (0.01, 0.5, 0.99), 20.0) == 0).all()
    for bad in (((2,), (3,), (0.1, 0.5, 0.9), 20), ((2,), (1,), (0, 0.5, 0.9), 20), ((2,), (1,), (0.1, 0.5, 0.9), 0)):
        with pytest.raises(ValueError):
            emissions.count_logs(*bad)


def test_count_column_equals_the_array(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n, a) for n in range(0, 12) for a in range(n + 1)], "n int, a int")
    cols = [emissions.count_log_column(F.col("n"), F.col("a"), t, 20.0).alias(f"e{k}") for k, t in enumerate((0.01, 0.5, 0.99))]
    got = np.array([list(r)[2:] for r in df.select("n", "a", *cols).orderBy("n", "a").collect()])
    pairs = [(n, a) for n in range(0, 12) for a in range(n + 1)]
    assert np.allclose(got, emissions.count_logs(*zip(*pairs), (0.01, 0.5, 0.99), 20.0), atol=1e-9)


def test_low_coverage_emission():
    logs = emissions.low_coverage_emission(np.array([10, 0, 0]), np.array([0, 10, 0]), 0.05, 0.05)
    p = np.exp(logs)
    assert (p >= 0.05 - 1e-12).all() and (p <= 0.95 + 1e-12).all()
    assert p[0].argmax() == 0 and p[1].argmax() == 2 and np.ptp(p[2]) == 0
    with pytest.raises(ValueError):
        emissions.low_coverage_emission(np.array([1]), np.array([1]), 0.5, 0.05)


def test_hard_call(spark):
    from pyspark.sql import functions as F

    a, n = np.array([0, 10, 5, 1, 2, 8, 0]), np.array([10, 10, 10, 2, 10, 10, 0])
    assert emissions.hard_call_array(a, n).tolist() == [0, 2, 1, 3, 3, 3, 3]
    df = spark.createDataFrame([(int(x), int(y), i) for i, (x, y) in enumerate(zip(a, n))], "a int, n int, i int")
    assert [r.g for r in df.withColumn("g", emissions.hard_call(F.col("a"), F.col("n"))).orderBy("i").collect()] == [0, 2, 1, 3, 3, 3, 3]


def test_fixed_point():
    assert emissions.fixed(np.array([0.0, -1.5e-9, -2.5e-9, -np.inf])).tolist() == [0, -2, -3, emissions.IMPOSSIBLE]


@pytest.mark.parametrize("reads,prior,af,expected", [((0, 1), "flat", None, 2), ((0, 1), "hwe", 0.3, 1), ((0, 1), "hwe", 0.06, 1), ((1, 0), "flat", None, 0), ((0, 10), "flat", None, 2), ((8, 8), "hwe", 0.3, 1), ((0, 0), "flat", None, None)])
def test_genotype_call(spark, reads, prior, af, expected):
    df = spark.createDataFrame([("a", 1, 1, *reads, af)], "name string, chr int, pos int, n_ref int, n_alt int, af double")
    assert call_gt(df, prior, af="af" if af is not None else None).first().g == expected


def test_genotype_posterior_and_errors(spark):
    df = spark.createDataFrame([("a", 1, 1, 3, 1), ("b", 1, 1, 0, 0)], "name string, chr int, pos int, n_ref int, n_alt int")
    got = {r.name: (r.p0, r.p1, r.p2) for r in call_gt(df, (0.5, 0.3, 0.2), ret="post").collect()}
    assert sum(got["a"]) == pytest.approx(1) and got["b"] == (None, None, None)
    for bad in ({"error": 0.5}, {"ret": "x"}, {"prior": (1, 2)}, {"prior": (0, 0, 0)}, {"prior": "none"}):
        with pytest.raises(ValueError):
            call_gt(df, **bad)


def test_seeded_uniforms():
    assert [round(x, 7) for x in rigid.uniforms(1, 3)] == [0.2655087, 0.3721239, 0.5728534]
