import numpy as np
import pytest

from mosaic_spark.functions.specs import CountEmission, GenotypeEmission, GeometricDuration
from mosaic_spark.operators import callers, segments
from mosaic_spark.schema import SchemaError

from .conftest import rows

COUNTS = "name string, chr int, pos int, n_ref int, n_alt int"


def cohort(spark, samples=6, markers=120, depth=6, seed=0, chroms=2):
    """Lines with one donor block each."""
    rng, data = np.random.default_rng(seed), []
    for s in range(samples):
        for c in range(1, chroms + 1):
            state = np.zeros(markers, int)
            state[30 + 5 * s : 70 + 5 * s] = 2
            n = rng.poisson(depth, markers)
            a = rng.binomial(n, np.array([0.01, 0.5, 0.99])[state])
            data += [(f"s{s}", c, int((i + 1) * 1000), int(x - y), int(y), int(t)) for i, (x, y, t) in enumerate(zip(n, a, state))]
    return spark.createDataFrame(data, COUNTS + ", truth int").repartition(5)


def accuracy(states, truth):
    j = states.join(truth.select("name", "chr", "pos", "truth"), ["name", "chr", "pos"])
    return j.selectExpr("avg(CAST(state = truth AS INT))").first()[0]


@pytest.fixture(scope="module")
def data(spark):
    return cohort(spark).cache()


@pytest.mark.parametrize("caller,extra", [("bbnil", {}), ("googa", {"atlas_min_reads": 3}), ("atlas", {"atlas_min_reads": 3, "rigidity": 4}), ("lbimpute", {"recombdist": 1e5}), ("binhmm", {"bin_size": 2000})])
def test_count_callers_find_the_block(data, caller, extra):
    states = callers.call_states(data, caller, design=None if caller == "lbimpute" else "BC2S3", **extra)
    if caller == "binhmm":
        assert states.columns == ["source", "donor", "name", "chr", "pos", "start_bp", "end_bp", "state"]
        assert states.where("state = 2").groupBy("name").count().count() == 6
        return
    assert states.columns == ["source", "donor", "name", "chr", "pos", "state"]
    assert accuracy(states, data) > 0.98


@pytest.mark.parametrize("caller", ["nnil", "catiger"])
def test_genotype_callers(spark, data, caller):
    calls = data.selectExpr("name", "chr", "pos", "CASE WHEN n_ref + n_alt = 0 THEN 3 WHEN n_alt > n_ref THEN 2 ELSE 0 END AS g", "truth")
    states = callers.call_states(calls, caller, design="BC2S3")
    assert states.count() == calls.where("g <> 3").count() and accuracy(states, data) > 0.98


def test_partitions_do_not_matter(spark, data):
    want = rows(callers.call_states(data, "bbnil", design="BC2S3"))
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert rows(callers.call_states(data.repartition(n), "bbnil", design="BC2S3")) == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_segments_cover_the_states(data):
    states = callers.call_states(data, "bbnil", design="BC2S3")
    segs = segments.to_segments(states)
    back = states.alias("s").join(segs.alias("g"), (states["name"] == segs["name"]) & (states["chr"] == segs["chr"]) & (states["pos"] >= segs["start_bp"]) & (states["pos"] <= segs["end_bp"]))
    assert back.count() == states.count() and back.where("s.state <> g.state").count() == 0


def test_minimum_run(data):
    segs = callers.call_ancestry(data, "atlas", design="BC2S3", rigidity=8, atlas_min_reads=3)
    inner = segs.where("start_bp > 1000 AND end_bp < 120000")
    assert inner.where("(end_bp - start_bp) / 1000 + 1 < 8").count() == 0


def test_float_precision_option(data):
    a, b = (callers.call_states(data, "bbnil", design="BC2S3", precision=p) for p in ("fixed", "float64"))
    assert a.join(b, ["name", "chr", "pos"]).where(a["state"] != b["state"]).count() < 30


def test_fitted_means_recover():
    rng = np.random.default_rng(0)
    state = np.repeat([0, 1, 2, 0, 2, 1, 0], 400)
    n = rng.poisson(2, len(state))
    a = rng.binomial(n, np.array([0.02, 0.5, 0.95])[state])
    chain = callers.transition(GeometricDuration(0.01), 0.3, 0.3)
    theta = callers.fit_theta([(n, a)], CountEmission(0.05, 200.0, True), chain)
    assert np.allclose(theta, [0.02, 0.5, 0.95], atol=0.05)


def test_fitted_means_caller(data):
    assert accuracy(callers.call_states(data, "bbnil", design="BC2S3", fit_means=True), data) > 0.98


def test_fit_and_decode():
    obs = [(10, 0), (9, 0), (11, 1), (8, 4), (12, 6)]
    model = callers.fit(obs, CountEmission(), GeometricDuration(1e-4), (0.0625, 0.0938))
    assert callers.decode(model, obs, CountEmission()).tolist() == [0, 0, 0, 1, 1]
    gt = callers.fit(None, GenotypeEmission(), GeometricDuration(0.01), (0.03, 0.1))
    assert callers.decode(gt, [0, 0, 2, 2, 2, 3, 2], GenotypeEmission()).tolist() == [0, 0, 2, 2, 2, 2, 2]


def test_lbimpute_paths(spark):
    r = [(10, 0)] * 20 + [(0, 10)] * 20 + [(10, 0)] * 20
    df = spark.createDataFrame([("a", 1, (i + 1) * 100_000, *x) for i, x in enumerate(r)], COUNTS)
    segs = sorted((x.start_bp, x.state) for x in callers.call_ancestry(df, "lbimpute").collect())
    assert [s for _, s in segs] == [0, 2, 0]
    same = spark.createDataFrame([("a", 1, 1, 5, 0, 1.0), ("a", 1, 2, 0, 5, 1.0), ("a", 1, 3, 5, 0, 1.0)], COUNTS + ", cm double")
    assert [(x.state) for x in callers.call_ancestry(same, "lbimpute", unit="cm").collect()] == [0]
    ragged = spark.createDataFrame([("A", 1, i, 9, 0) for i in (1, 2, 3)] + [("B", 1, i, 0, 9) for i in (5, 6)], COUNTS)
    assert rows(callers.call_ancestry(ragged, "lbimpute").select("name", "state")) == [("A", 0), ("B", 2)]


def test_lbimpute_errors(spark):
    df = spark.createDataFrame([("a", 1, 1, 5, 0)], COUNTS)
    with pytest.raises(SchemaError):
        callers.call_states(df, "lbimpute", unit="cm")
    with pytest.raises(ValueError):
        callers.call_states(df, "lbimpute", recombdist=0)
    with pytest.warns(UserWarning, match="over-fragment|cM-sized"):
        callers.call_states(df, "lbimpute", recombdist=50)


def test_sweep_equals_cold_calls(data):
    swept = callers.caller_sweep(data, "bbnil", [0.001, 0.05], design="BC2S3")
    for r in (0.001, 0.05):
        cold = callers.call_ancestry(data, "bbnil", design="BC2S3", rrate=r)
        assert rows(swept.where(f"rrate = {r}").drop("rrate")) == rows(cold)
    lb = callers.caller_sweep(data, "lbimpute", [1e5, 1e6])
    assert rows(lb.where("recombdist = 100000").drop("recombdist")) == rows(callers.call_ancestry(data, "lbimpute", recombdist=1e5))
    fitted = callers.caller_sweep(data, "bbnil", [0.01], design="BC2S3", fit_means=True, refit="cold")
    assert rows(fitted.drop("rrate")) == rows(callers.call_ancestry(data, "bbnil", design="BC2S3", fit_means=True))
    assert callers.caller_sweep(data, "bbnil", [0.01, 0.02], design="BC2S3", fit_means=True).select("rrate").distinct().count() == 2
    with pytest.raises(ValueError):
        callers.caller_sweep(data, "googa", [1])
    with pytest.raises(ValueError):
        callers.caller_sweep(data, "bbnil", [])


def test_rtiger(spark, data):
    fit = callers.fit_rtiger(data, 4)
    mean = fit.alpha / (fit.alpha + fit.beta)
    assert mean[0] > 0.95 and mean[2] < 0.05 and 1 <= fit.iterations <= 50
    again = callers.fit_rtiger(data.repartition(1), 4)
    assert (again.alpha == fit.alpha).all() and (again.A == fit.A).all()
    states = callers.call_states(data, "rtiger", rigidity=4, fit=fit)
    assert accuracy(states, data) > 0.98
    swept = callers.caller_sweep(data, "rtiger", [4], ref=4)
    assert rows(swept.drop("rigidity")) == rows(callers.call_ancestry(data, "rtiger", rigidity=4))
    with pytest.raises(callers.NoData, match="chain"):
        callers.call_states(data, "rtiger", rigidity=100)


def test_rtiger_multistart(data):
    fit = callers.fit_rtiger_multistart(data.where("chr = 1"), 4, starts=2, probe_iter=2, max_iter=5)
    assert fit.alpha[0] > fit.beta[0]


def test_binhmm_backends(data):
    for method, joint, weighted in (("gmm", False, False), ("kmeans", False, False), ("gmm", True, True), ("kmeans", True, False)):
        states = callers.call_states(data, "binhmm", design="BC2S3", bin_size=2000, cluster_method=method, joint_clust=joint, obs_weights=weighted)
        assert states.where("state = 2").count() > 60
    with pytest.raises(RuntimeError):
        callers.call_states(data, "binhmm", design="BC2S3", cluster_method="rebmix")
    binned = segments.bin_counts(data, 2000).withColumnRenamed("bin", "pos")
    assert rows(callers.call_states(binned, "binhmm", design="BC2S3")) == rows(callers.call_states(data, "binhmm", design="BC2S3", bin_size=2000))


def test_fsfhap_routes(spark):
    from mosaic_spark.operators.simulate import simulate_backcross_panel

    panel = simulate_backcross_panel(spark, 60, 400, 1)
    got = callers.call_states(panel, "fsfhap", design="BC1S4").join(panel.select("name", "chr", "pos", panel["state"].alias("t")), ["name", "chr", "pos"])
    assert got.count() > 10_000 and got.selectExpr("avg(CAST(state = t AS INT))").first()[0] > 0.93
    even = simulate_backcross_panel(spark, 80, 400, 1, donor_frac=0.5, phet=0.0, miss=0.02)
    assert callers.call_states(even, "fsfhap", design="BC0S4").columns == ["source", "donor", "name", "chr", "pos", "state"]
    with pytest.raises(ValueError):
        callers.call_states(panel, "fsfhap")
    with pytest.raises(SchemaError):
        callers.call_states(panel.drop("family"), "fsfhap", design="BC1S4")


def test_pedigree_and_refinement(spark):
    from mosaic_spark.operators.simulate import simulate_counts, simulate_family

    truth, ped = simulate_family(spark, "BC2S3", 2, 5, n_markers=100, chr=[1, 2])
    counts = simulate_counts(truth, depth=1.0).join(truth.select("name", "chr", "pos", "cm"), ["name", "chr", "pos"])
    states = callers.call_states(counts, "pedigree", design="BC2S3", pedigree=ped)
    ok = states.join(truth.select("name", "chr", "pos", truth["state"].alias("t")), ["name", "chr", "pos"])
    assert states.count() == truth.count() and ok.selectExpr("avg(CAST(state = t AS INT))").first()[0] > 0.85
    mosaic = callers.call_states(counts, "bbnil", design="BC2S3").join(truth.select("name", "chr", "pos", "cm"), ["name", "chr", "pos"])
    refined = callers.refine_ancestry(mosaic, ped, "BC2S3")
    assert refined.columns == mosaic.columns and refined.count() == mosaic.count()
    via = callers.call_states(mosaic, "pedigree", design="BC2S3", pedigree=ped)
    assert rows(refined.select("name", "chr", "pos", "state")) == rows(via.select("name", "chr", "pos", "state"))
    with pytest.raises(ValueError, match="exactly one root"):
        callers.call_states(counts, "pedigree", design="BC2S3", pedigree=ped.where("NOT endswith(taxon, '_g1')"))


def test_families_are_dealt_to_tasks_by_their_number(spark):
    from mosaic_spark.operators.simulate import simulate_counts, simulate_family

    truth, ped = simulate_family(spark, "BC2S3", 2, 3, n_markers=20, chr=[1, 2])
    states = callers.call_states(simulate_counts(truth, depth=1.0), "pedigree", design="BC2S3", pedigree=ped)
    assert states.rdd.getNumPartitions() == 32 and states.count() == truth.count()


def test_contracts(spark, data):
    for bad, error in (({"caller": "nope"}, ValueError), ({"caller": "nnil", "design": "BC2S3"}, SchemaError), ({"caller": "bbnil"}, ValueError), ({"caller": "bbnil", "design": "x"}, ValueError), ({"caller": "pedigree"}, ValueError), ({"caller": "bbnil", "design": "BC1S1", "what": 1}, TypeError)):
        with pytest.raises(error):
            callers.call_states(data, **bad)
    assert callers.call_states(data, "bbnil", design="BC2S3", threads=8).count() == data.where("n_ref + n_alt > 0").count()
    empty = data.limit(0)
    for caller in ("bbnil", "googa", "lbimpute", "binhmm"):
        assert callers.call_states(empty, caller, design="BC2S3").count() == 0


def test_pedigree_queries_keep_the_default_sweeps(monkeypatch):
    from mosaic_spark.plans import queries as q

    seen = []
    for name in ("obs", "_pedigree"):
        monkeypatch.setattr(q, name, lambda *a: None)
    for name in ("call_states", "refine_ancestry"):
        monkeypatch.setattr(q.callers, name, lambda *a, **k: seen.append(k))
    q.pedigree_states(None, ""), q.refined_ancestry(None, "")
    assert len(seen) == 3 and not any({"ped_maxiter", "maxiter"} & set(k) for k in seen)
