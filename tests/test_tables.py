import gzip
import itertools
import math

import numpy as np
import pytest

from mosaic_spark.operators import calibrate, interpolate, maps, segments, simulate, thinning
from mosaic_spark.sources import readers, writers

from .conftest import rows


def put(path, text):
    path.write_text(text)
    return str(path)


def test_count_files(spark, tmp_path):
    put(tmp_path / "S1.chr1.tsv", "chr1\t100\tA\t5\tC\t0\n1\t200\tG\t0\tT\t3\nchrX\t5\tA\t1\tC\t1\n")
    with gzip.open(tmp_path / "S2.tsv.gz", "wt") as f:
        f.write("2\t7\tA\t1\tC\t2\n")
    got = rows(readers.read_counts(spark, str(tmp_path)))
    assert got == sorted([("S1", 1, 100, 5, 0), ("S1", 1, 200, 0, 3), ("S1", None, 5, 1, 1), ("S2", 2, 7, 1, 2)], key=repr)
    assert readers.read_counts(spark, str(tmp_path / "S1.chr1.tsv"), name="me").first()["name"] == "me"
    with pytest.raises(NotImplementedError):
        readers.read_counts(spark, str(tmp_path), "gatk_table")


VCF = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n"


def test_vcf_counts(spark, tmp_path):
    body = "chr1\t10\t.\tA\tC\t50\t.\t.\tGT:AD:DP\t0/1:3,4:7\t0/0\n1\t20\t.\tA\tC,G\t9\t.\t.\tAD:GT\t1,2,3:0/1\t.:./.\n2\t30\t.\tA\tC\t.\t.\t.\tGT\t0/0\t0/1\n"
    path = put(tmp_path / "x.vcf", VCF + body)
    with pytest.warns(UserWarning, match="without AD"):
        got = rows(readers.read_counts(spark, path, "vcf_ad"))
    assert got == sorted([("a", 1, 10, 3, 4), ("b", 1, 10, 0, 0), ("a", 1, 20, 1, 2), ("b", 1, 20, 0, 0), ("a", 2, 30, 0, 0), ("b", 2, 30, 0, 0)], key=repr)
    assert rows(readers.read_vcf_counts(spark, path, True)) == [("a", 1, 10, 3, 4), ("b", 1, 10, 0, 0)]
    with pytest.raises(readers.FormatError, match="no `AD`"):
        readers.read_counts(spark, put(tmp_path / "y.vcf", VCF + "1\t1\t.\tA\tC\t.\t.\t.\tGT\t0/0\t0/1\n"), "vcf_ad")
    with pytest.raises(readers.FormatError, match="no #CHROM"):
        readers.read_counts(spark, put(tmp_path / "z.vcf", "##only\n"), "vcf_ad")
    kept = readers.filter_vcf(spark, path, min_qual=10, snps_only=True)
    assert kept.select("pos").distinct().collect()[0].pos == 10
    assert readers.filter_vcf(spark, path, max_missing=0.2).select("pos").distinct().count() == 2


def test_vcf_genotypes(spark, tmp_path):
    body = "".join(f"1\t{p}\t.\tA\tC\t.\t.\t.\tGT:DP\t{x}:3\t{y}\n" for p, x, y in ((1, "0/0", "0|1"), (2, "0/2", "1/2"), (3, "./.", "./1"), (4, "1", "0")))
    path = put(tmp_path / "g.vcf", VCF + body)
    got = {(r["name"], r.pos): r.g for r in readers.read_vcf_gt(spark, path).collect()}
    assert [got["a", p] for p in (1, 2, 3, 4)] == [0, 1, 3, 2] and [got["b", p] for p in (1, 2, 3, 4)] == [1, 2, 3, 0]
    assert readers.read_vcf_gt(spark, path, ["b"]).select("name").distinct().count() == 1
    with pytest.raises(readers.FormatError):
        readers.read_vcf_gt(spark, path, ["zz"])


def test_hapmap(spark, tmp_path):
    head = "rs#\talleles\tchrom\tpos\tstrand\tassembly#\tcenter\tprotLSID\tassayLSID\tpanelLSID\tQCcode\tt1\tt.2\n"
    line = lambda p, a, x, y: f"m\t{a}\tchr3\t{p}\t+\tNA\tNA\tNA\tNA\tNA\tNA\t{x}\t{y}\n"
    path = put(tmp_path / "h.hmp.txt", head + line(1, "A/C", "A", "C") + line(2, "A/C", "M", "N") + line(3, "G/T", "GG", "TG") + line(4, "T/G", "K", "A"))
    got = {(r["name"], r.pos): r.g for r in readers.read_hapmap(spark, path).collect()}
    assert [got["t1", p] for p in (1, 2, 3, 4)] == [0, 1, 0, 1] and [got["t.2", p] for p in (1, 2, 3, 4)] == [2, 3, 1, 3]
    with pytest.raises(readers.FormatError):
        readers.read_hapmap(spark, put(tmp_path / "bad.txt", "a\tb\n1\t2\n"))


def test_plink(spark, tmp_path):
    g = np.array([[2, 1, 0, 3, 1], [0, 2, 1, 3, 2]])
    code = {2: 0, 3: 1, 1: 2, 0: 3}
    raw = bytearray(b"\x6c\x1b\x01")
    for row in g:
        for i in range(0, 5, 4):
            raw.append(sum(code[int(x)] << (2 * k) for k, x in enumerate(row[i : i + 4])))
    (tmp_path / "p.bed").write_bytes(raw)
    put(tmp_path / "p.bim", "chr1 s1 0 100 A C\n2 s2 0 200 A C\n")
    put(tmp_path / "p.fam", "".join(f"f t{i} 0 0 0 -9\n" for i in range(5)))
    got = {(r["name"], r.pos): (r.chr, r.g) for r in readers.read_plink(spark, str(tmp_path / "p")).collect()}
    assert all(got[f"t{i}", p][1] == g[k, i] for i in range(5) for k, p in enumerate((100, 200))) and got["t0", 200][0] == 2
    (tmp_path / "p.bed").write_bytes(raw[:-1])
    with pytest.raises(readers.FormatError, match="size"):
        readers.read_plink(spark, str(tmp_path / "p.bed"))
    (tmp_path / "p.bed").write_bytes(b"abc" + raw[3:])
    with pytest.raises(readers.FormatError, match="magic"):
        readers.read_plink(spark, str(tmp_path / "p"))


def test_plink_variants_stay_off_the_driver(spark, tmp_path, monkeypatch):
    """Lines of many splits, some of them blank, meet the packed bits by their place in the file."""
    n, taxa = 3_000, 6
    g = np.random.default_rng(5).integers(0, 4, (n, taxa))
    codes = np.pad(np.array([3, 2, 0, 1])[g], ((0, 0), (0, 2))).reshape(n, 2, 4)
    (tmp_path / "p.bed").write_bytes(b"\x6c\x1b\x01" + (codes << np.array([0, 2, 4, 6])).sum(axis=2).astype(np.uint8).tobytes())
    put(tmp_path / "p.bim", "".join(f"{k % 5 + 1} s{k} 0 {(k * 7919) % n} A C\n" + "\n" * (k % 3 == 0) for k in range(n)))
    put(tmp_path / "p.fam", "".join(f"f t{i} 0 0 0 -9\n" for i in range(taxa)))
    collected, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: collected.append(out := collect(df)) or out)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = readers.read_plink(spark, str(tmp_path / "p"))
        assert max(map(len, collected)) < 100
        got = {(r["name"], r.pos): (r.chr, r.g) for r in found.toLocalIterator()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(f"t{i}", (k * 7919) % n): (k % 5 + 1, g[k, i]) for k in range(n) for i in range(taxa)}


def test_pedigrees(spark, tmp_path):
    path = put(tmp_path / "p.txt", "fam\ttax\tp1\tp2\tc1\tc2\tF\nF1\ta\tx\ty\t0.75\tbad\t0.9\n")
    assert tuple(readers.read_pedigree(spark, path).first()) == ("a", "F1", "x", "y", 0.75, None, 0.9)
    fam = put(tmp_path / "p.fam", "F1 a  x y 0 -9\nF1 b\n")
    assert rows(readers.read_pedigree(spark, fam, "fam").select("taxon", "parent1")) == [("a", "x"), ("b", None)]
    with pytest.raises(readers.FormatError):
        readers.read_pedigree(spark, put(tmp_path / "q.txt", "a\tb\n1\t2\n"))


def states(spark, data, extra=""):
    return spark.createDataFrame(data, "name string, chr int, pos int, state int" + extra)


def test_segments(spark):
    st = states(spark, [("a", 1, p, s) for p, s in ((1, 0), (5, 0), (9, 2), (12, 2), (13, 0))] + [("b", 1, 1, 2), ("a", 2, 4, 0)])
    got = rows(segments.to_segments(st).select("name", "chr", "start_bp", "end_bp", "state"))
    assert got == sorted([("a", 1, 1, 5, 0), ("a", 1, 9, 12, 2), ("a", 1, 13, 13, 0), ("a", 2, 4, 4, 0), ("b", 1, 1, 1, 2)], key=repr)
    bins = states(spark, [("a", 1, 0, 1, 10, 40), ("a", 1, 1, 1, 60, 90)], ", start_bp int, end_bp int")
    assert rows(segments.to_segments(bins).select("start_bp", "end_bp")) == [(10, 90)]
    assert segments.to_segments(st.limit(0)).count() == 0


def test_gap_fill_and_despeckle(spark):
    seq = [0, 3, 3, 0, 2, 3, 0, 1, 3, 1]
    st = states(spark, [("a", 1, i, s) for i, s in enumerate(seq)])
    assert [r.state for r in segments.fill_gaps(st).orderBy("pos").collect()] == [0, 0, 0, 0, 2, 3, 0, 1, 1, 1]
    st = states(spark, [("a", 1, i, s) for i, s in enumerate([2, 0, 1, 1, 0, 2, 2])])
    assert [r.state for r in segments.despeckle(st).orderBy("pos").collect()] == [0, 0, 1, 1, 0, 2, 2]


def test_blocks_and_ks(spark):
    st = states(spark, [("a", 1, p * 1_000_000, s) for p, s in ((1, 2), (2, 1), (4, 0), (6, 2))])
    assert rows(segments.donor_blocks(st).select("start_bp", "end_bp")) == [(1e6, 3e6), (5e6, 6e6)]
    a, b = (spark.createDataFrame([(float(x),) for x in v], "mb double") for v in ((1, 2, 2, 3), (2, 3, 4, 5)))
    assert segments.ks_distance(a, b).first().d == 0.5


def test_results_are_written(spark, tmp_path):
    st = states(spark, [("a", 1, 10, 0), ("a", 1, 20, 2), ("b", 1, 10, 1)])
    out = writers.write_vcf_impute(st, str(tmp_path / "v"), spark.createDataFrame([(1, 10, "A", "G", "m1")], "chr int, pos int, ref string, alt string, id string"))
    lines = [line for p in sorted((tmp_path / "v").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines[0] == "##fileformat=VCFv4.2" and lines[3].endswith("FORMAT\ta\tb")
    assert lines[4:] == ["1\t10\tm1\tA\tG\t.\t.\t.\tGT\t0/0\t0/1", "1\t20\t.\tN\tN\t.\t.\t.\tGT\t1/1\t./."]
    assert rows(readers.read_vcf_gt(spark, out)) == sorted([("a", 1, 10, 0), ("b", 1, 10, 1), ("a", 1, 20, 2), ("b", 1, 20, 3)])
    with pytest.raises(writers.DuplicateKeys):
        writers.write_vcf_impute(st.unionByName(st), str(tmp_path / "w"))
    segs = segments.to_segments(st)
    writers.write_common_schema(segs, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns == ["source", "donor", "name", "chr", "start_bp", "end_bp", "state"]
    writers.write_results(st, str(tmp_path / "r"), {"nir": 0.1})
    assert spark.read.option("header", "true").csv(str(tmp_path / "r/summary")).count() == 2


def test_painting(spark):
    segs = segments.to_segments(states(spark, [("a", 1, 10, 0), ("a", 1, 20, 2)])).withColumnRenamed("source", "src")
    got = segments.paint_calls(segs).orderBy("x0").collect()
    assert [(r.label, r.y0, r.y1) for r in got] == [("REF", 0.0, 1.0), ("ALT", 0.0, 1.0)]
    with pytest.raises(ValueError):
        segments.paint_calls(segs, palette={"a": "b"})
    with pytest.raises(NotImplementedError):
        segments.plot_fragment_sizes(segs)


def geno(spark, matrix):
    data = [(i, j, None if v is None else float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    return spark.createDataFrame(data, "marker int, sample int, dosage double")


def test_pair_values(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(0, 3, (6, 30)).astype(object)
    m[0, 3] = m[2, 5] = None
    m[5] = 1
    got = {(r.i, r.j): r.value for r in thinning.pairwise_distance(geno(spark, m), "r2").collect()}
    assert len(got) == 15
    for (i, j), v in got.items():
        ok = [(a, b) for a, b in zip(m[i], m[j]) if a is not None and b is not None]
        x, y = np.array(ok, float).T
        want = 0.0 if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1] ** 2
        assert v == pytest.approx(want)
    square = geno(spark, [[0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 1, 2] * 3])
    assert thinning.pairwise_distance(square, "mi").first().value == pytest.approx(-4 / 18)
    nats, bits = (thinning.pairwise_distance(square, "vi", b).first().value for b in ("nats", "bits"))
    assert bits == pytest.approx(nats / math.log(2))
    with pytest.raises(thinning.MarkerBudget):
        thinning.pairwise_distance(square, max_markers=1)
    with pytest.raises(thinning.MarkerBudget):
        thinning.check_budget(5, 40_000)


def test_information_is_a_metric(spark):
    rng = np.random.default_rng(2)
    vi = {(r.i, r.j): r.value for r in thinning.pairwise_distance(geno(spark, rng.integers(0, 3, (5, 400))), "vi").collect()}
    d = lambda a, b: 0 if a == b else vi[min(a, b), max(a, b)]
    assert all(d(a, c) <= d(a, b) + d(b, c) + 0.02 for a, b, c in itertools.permutations(range(5), 3))


def test_vcf_cells_are_shuffled_once(spark):
    """Cells get their sample's number without a shuffle by name, whatever the threshold."""
    st = spark.createDataFrame([("b", 1, 10, 2), ("a", 1, 20, 0)], "name string, chr int, pos int, state int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        body = writers.vcf_lines(st)[1]
        plan = body._jdf.queryExecution().executedPlan().toString()
        got = rows(body.selectExpr("pos", "split(value, '\\t')[9]", "split(value, '\\t')[10]"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and got == [(10, "./.", "1/1"), (20, "0/0", "./.")]


def test_pairs_by_tiles(spark):
    """Two groups of markers over samples of their own, more than a tile each; tasks by pairs of blocks."""
    rng, n = np.random.default_rng(3), thinning.TILE + 20
    m = rng.integers(0, 3, (2 * n, 40)).astype(float)
    m[rng.random(m.shape) < 0.3] = np.nan
    m[:n, 25:], m[n:, :25] = np.nan, np.nan
    data = [(c, i, j, float(v)) for c in range(1, 7) for i, row in enumerate(m if c == 1 else m[:2]) for j, v in enumerate(row) if v == v]
    found = thinning.pairwise_distance(spark.createDataFrame(data, "chr int, marker int, sample int, dosage double"), per_chr=True)
    assert found.rdd.getNumPartitions() >= 12
    got = {(r.i, r.j): r.value for r in found.where("chr = 1").collect()}
    assert len(got) == n * (2 * n - 1)
    for i, j in [(0, 1), (0, thinning.TILE), (5, n - 1), (3, n), (n, 2 * n - 1), *rng.integers(0, 2 * n, (300, 2)).tolist()]:
        i, j = min(i, j), max(i, j)
        x, y = m[i], m[j]
        both = ~np.isnan(x) & ~np.isnan(y)
        plain = i != j and both.sum() > 1 and x[both].std() > 0 and y[both].std() > 0
        assert i == j or got[i, j] == pytest.approx(np.corrcoef(x[both], y[both])[0, 1] ** 2 if plain else 0.0, abs=1e-12)
    codes, values = [np.array([1, 5, 9]), np.array([5]), np.array([9, 2])], [np.ones(3), np.full(1, 2.0), np.zeros(2)]
    x, y = thinning._Tile(0, 2, codes, values), thinning._Tile(2, 3, codes, values)
    assert [a.tolist() for a in x.met(np.array([2]))] == [[0], [0], [1.0]] and y.samples.tolist() == [2, 9]


def test_bins_cost_one_shuffle(spark):
    """Sums by part and by bin and a marker's cells need no shuffle but that by marker; rows are those of the SQL."""
    from mosaic_spark.plans import views

    d = "/root/testdata/sf0.001"
    got = views.bin_genotypes(spark, d)
    plan = got.groupBy("chr", "marker").count()._jdf.queryExecution().executedPlan().toString()
    want = spark.sql(views.BIN_GENO.format(obs="{obs}", div="DIV"), obs=views.obs(spark, d))
    assert plan.count("Exchange hashpartitioning") == 1
    assert got.dtypes == want.dtypes and rows(got) == rows(want)


def test_bins_come_as_vectors(spark, tmp_path):
    """A row a marker with numbers for names: the same cells as the rows, and the same pairs."""
    from mosaic_spark.plans import views

    line = "l_suppkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double"
    odd = [(7, 1, 99, -5.0, 0.1), (7, 1, 99, 9.0, 0.1), (8, 1, 98, None, 0.1), (8, 1, 97, 4.0, None), (2**40, 1, 2**33, 3.0, 0.1), (-9, 1, 1, 5.0, 0.1), (3, None, 5, 5.0, 0.1)]
    spark.createDataFrame(odd, line).write.parquet(f"{tmp_path}/odd/lineitem.parquet")
    spark.createDataFrame([*odd, (None, 1, 199, 5.0, 0.1)], line).write.parquet(f"{tmp_path}/none/lineitem.parquet")
    for path in ("/root/testdata/sf0.001", f"{tmp_path}/odd"):
        plain = views.bin_genotypes(spark, path).where("chr IS NOT NULL")
        got = views.bin_genotypes(spark, path, True)
        cells = got.selectExpr("chr", "marker", "explode(arrays_zip(codes, values)) AS c").selectExpr("chr", "marker", "concat('S', c.codes)", "CAST(c.values AS INT)")
        assert rows(cells) == rows(plain.select("chr", "marker", "sample", "dosage"))
        assert got.select("chr", "marker").distinct().count() == got.count()
        for method in ("r2", "vi"):
            assert rows(thinning.pairwise_distance(got, method, per_chr=True)) == rows(thinning.pairwise_distance(plain, method, per_chr=True))
    lone = views.bin_genotypes(spark, f"{tmp_path}/none", True).where("marker = 1000002").collect()
    assert [(r.codes, r["values"]) for r in lone] == [([], [])]
    assert views._order(np.array([2**62, 5, 5]), np.array([0, 9, 2**62])).tolist() == [1, 2, 0]


def test_pairs_without_a_common_sample_cost_no_matrix(spark):
    """Tiles that share no sample come as names alone; thresholds of 0 and below keep their pairs."""
    cells = [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 2.0), ("b", 1, 0.0), ("b", 2, 2.0), ("b", 3, 2.0), ("c", 7, 1.0), ("d", 7, None)]
    data = spark.createDataFrame(cells, "marker string, sample int, dosage double")
    want = {(i, j): 0.0 for i, j in itertools.combinations("abcd", 2)} | {("a", "b"): 0.75}
    for least, kept in ((None, 6), (0.0, 6), (-1.0, 6), (0.5, 1), (0.8, 0)):
        got = {(r.i, r.j): r.value for r in thinning.pairwise_distance(data, least=least).collect()}
        assert len(got) == kept and all(v == pytest.approx(want[k]) for k, v in got.items())
    part = thinning._rows(thinning.pa.array([1]), [False], thinning.pa.array(["a", "b"]), [0, 2], thinning.pa.array(["c"]), None, [0, 1])
    assert part.column(4).null_count == 1 and part.column(4).values.nbytes == 0


def test_tiles_come_in_strips():
    """The engine holds all pairs of a row: a tile as one row was 65,536 of them."""
    markers, codes, values = thinning.pa.array(np.arange(thinning.TILE)), [np.array([1])] * thinning.TILE, [np.ones(1)] * thinning.TILE
    x, y = thinning._Tile(0, 100, codes, values), thinning._Tile(100, 130, codes, values)
    for a, b in ((x, x), (x, y)):
        value = np.arange(len(a) * len(b), dtype=float).reshape(len(a), len(b))
        got = [(i, j, r["value"][k * len(r["right"]) + q]) for r in thinning._strips(thinning.pa.scalar(1), markers, a, b, value).to_pylist() for k, i in enumerate(r["left"]) for q, j in enumerate(r["right"]) if q > k + r["skip"] and len(r["left"]) <= thinning.STRIP]
        assert got == [(i, j, value[i - a.first, j - b.first]) for i in range(a.first, a.end) for j in range(b.first, b.end) if a is not b or i < j]


def test_sums_in_single_precision_are_exact():
    rng = np.random.default_rng(8)
    for high, short in ((3, True), (90, True), (92, False)):
        codes, values = [np.arange(3000)] * 4, [rng.integers(0, high, 3000).astype(float) for _ in range(4)]
        values[0][0] = high - 1
        x, y = thinning._Tile(0, 2, codes, values), thinning._Tile(2, 4, codes, values)
        for a, b in ((x, x), (x, y)):
            one = a.met(np.arange(3000))
            two = one if a is b else b.met(np.arange(3000))
            assert thinning._short(one[2]) == short
            got = thinning._correlations(one, two, (2, 2), 3000)
            want = np.corrcoef(values[a.first : a.end], values[b.first : b.end])[:2, 2:] ** 2
            assert got == pytest.approx(want, abs=1e-12)
    assert not thinning._short(np.array([0.5])) and thinning._short(np.zeros(0))


def test_independent_r2_reads_genotypes_once(spark, monkeypatch):
    from mosaic_spark.plans import queries

    read, plain = [], queries.bin_genotypes
    monkeypatch.setattr(queries, "bin_genotypes", lambda *a: read.append(1) or plain(*a))
    found = queries.independent_r2(spark, "/root/testdata/sf0.001").collect()
    spark.catalog.clearCache()
    assert len(read) == 1 and {r.chr for r in found} == set(range(1, 8))


def test_position_thinning(spark):
    pos = [0.0, 0.05, 0.12, 0.3, 0.31, 0.45, 0.5, 0.58, 0.9, 0.97]
    markers = spark.createDataFrame([(i, 1, p) for i, p in enumerate(pos)], "marker int, chr int, pos double")
    near = thinning.position_distance(markers, within=0.1)
    every = thinning.position_distance(markers)
    assert every.count() == 45 and rows(every.where("value <= 0.1")) == rows(near)
    got = sorted(int(r.marker) for r in thinning.select_independent(markers, near, 0.1, "distance").where("set = 0").collect())
    assert all(pos[b] - pos[a] > 0.1 for a, b in zip(got, got[1:]))
    sweep, last = 0, -1.0
    for p in pos:
        if p - last > 0.1:
            sweep, last = sweep + 1, p
    assert len(got) == sweep
    two = spark.createDataFrame([(1, 1, 0.0), (2, 2, 0.0)], "marker int, chr int, pos double")
    assert thinning.position_distance(two).first().value == float("inf")


def panel(spark, values, cm):
    return spark.createDataFrame([(1, float(c), "s", float(v)) for c, v in zip(cm, values)], "chr int, cm double, sample string, dosage double")


def at(spark, cm):
    return spark.createDataFrame([(1, float(c)) for c in cm], "chr int, cm double")


@pytest.mark.parametrize("mode,want", [("continuous", [0, 0.5, 1, 1.5, 2]), ("step", [0, 0, 2, 2, 2]), ("round", [0, 1, 1, 2, 2])])
def test_interpolation(spark, mode, want):
    got = interpolate.interpolate_genotype(panel(spark, [0, 2], [0, 1]), at(spark, [0, 0.25, 0.5, 0.75, 1]), mode)
    assert [r.dosage for r in got.orderBy("cm").collect()] == want


@pytest.mark.parametrize("values,want", [((0, 0), [None, 0, 0, 0, None]), ((0, 2), [None, 0, None, 2, None])])
def test_concordant_interpolation(spark, values, want):
    got = interpolate.interpolate_genotype(panel(spark, values, [0, 2]), at(spark, [-1, 0, 1, 2, 3]), "chen2019")
    assert [r.dosage for r in got.orderBy("cm").collect()] == want


def test_interpolation_checks(spark):
    with pytest.raises(ValueError, match="increasing"):
        interpolate.interpolate_genotype(panel(spark, [0, 1], [1, 1]), at(spark, [1]))
    with pytest.raises(ValueError, match="no observed"):
        interpolate.interpolate_genotype(panel(spark, [0, 1], [1, 2]), spark.createDataFrame([(9, 1.0)], "chr int, cm double"))
    with pytest.raises(ValueError, match="mode"):
        interpolate.interpolate_genotype(panel(spark, [0], [1]), at(spark, [1]), "x")


def test_maps(spark):
    from pyspark.sql import functions as F

    table = readers.load_map(spark)
    to, back = maps.bp_to_cm(table), maps.cm_to_bp(table)
    df = spark.createDataFrame([(1, 5e6), (2, 1.5e8), (3, -5.0)], "chr int, bp double")
    got = df.withColumn("cm", to.column(F.col("chr"), F.col("bp"))).withColumn("again", back.column(F.col("chr"), F.col("cm"))).orderBy("chr").collect()
    assert all(abs(r.again - r.bp) < 1e4 for r in got[:2]) and got[2].cm == 0
    grid = maps.build_marker_grid(table, 300)
    assert 290 <= grid.count() <= 310 and grid.groupBy("chr").count().where("count < 2").count() == 0
    with pytest.raises(KeyError):
        to.values([99], [1.0])
    with pytest.raises(ValueError):
        readers.load_map(spark, version="v9")


def test_simulated_designs(spark):
    truth = simulate.simulate_nil(spark, "BC2S2", 200, n_markers=60, chr=[1, 2, 3])
    share = {r.state: r["count"] / truth.count() for r in truth.groupBy("state").count().collect()}
    assert share[0] == pytest.approx(0.84375, abs=0.03) and share[2] == pytest.approx(0.09375, abs=0.03)
    assert rows(truth.where("name = 'sim0003'")) == rows(simulate.simulate_nil(spark, "BC2S2", 3, n_markers=60, chr=[1, 2, 3]).where("name = 'sim0003'"))
    counts = simulate.simulate_counts(truth, 3.0, 0.01, 0.1)
    assert rows(simulate.simulate_counts(truth.repartition(7), 3.0, 0.01, 0.1).limit(0)) == []
    depth = counts.selectExpr("avg(n_ref + n_alt) AS d", "avg(CAST(g = 3 AS INT)) AS m").first()
    assert depth.d == pytest.approx(2.7, abs=0.1) and depth.m == pytest.approx(0.1 + 0.9 * math.exp(-3), abs=0.02)
    fam, ped = simulate.simulate_family(spark, "BC2S3", 2, 4, n_markers=40, chr=[1])
    assert fam.select("name").distinct().count() == 8 and ped.where("parent1 IS NULL").count() == 2
    with pytest.raises(ValueError):
        simulate.simulate_family(spark, "BC2S0")


def test_calibration(spark):
    truth = simulate.simulate_nil(spark, "BC2S2", 30, n_markers=400, chr=[1, 2])
    counts = simulate.simulate_counts(truth, 2.0)
    sim = segments.donor_blocks(truth).select("mb")
    best = calibrate.calibrate_r(counts, sim, [1e-4, 0.01, 0.3], design="BC2S2").collect()
    assert len(best) == 1 and 0 <= best[0].d < 0.5 and best[0].value in (1e-4, 0.01)
    sweep = calibrate.ks_sweep(counts, sim, [0.01], design="BC2S2").first()
    from mosaic_spark.operators.callers import call_states

    direct = segments.ks_distance(segments.donor_blocks(call_states(counts, "bbnil", design="BC2S2", rrate=0.01)), sim).first().d
    assert sweep.d == pytest.approx(direct)


def test_parameter_grid(spark):
    truth = simulate.simulate_nil(spark, "BC2S2", 8, n_markers=100, chr=[1])
    geno_ = simulate.simulate_counts(truth, 3.0)
    grid = {"nir": (0.01, 0.3), "germ": (0.01,), "gert": (0.05,), "p": (0.5,), "r_multiplier": (1.0,)}
    table = calibrate.optimize_parameters(geno_, grid)
    assert table.count() == 2 and calibrate.select_best_parameters(table, "balanced").count() == 1
    one = table.where("nir = 0.01").first()
    direct = segments.quality_metrics(calibrate.call_introgressions(geno_.where("g <= 3"), nir=0.01, germ=0.01, gert=0.05, mr=0.15)).first()
    assert one.pct_ref == pytest.approx(direct.pct_ref, abs=2.0)
    est = calibrate.estimate_data_parameters(geno_).first()
    assert 0 < est.missing_rate < 0.2 and calibrate.recombination_rate(300) == 0.1
    assert calibrate.invalid_genotypes(geno_).count() == 0
    with pytest.raises(ValueError):
        calibrate.select_best_parameters(table, "x")


def test_streams(spark, tmp_path):
    from mosaic_spark.streaming import calls

    src = tmp_path / "in"
    src.mkdir()
    for s in range(3):
        put(src / f"S{s}.tsv", "".join(f"chr1\t{(i + 1) * 1000}\tA\t{0 if 20 <= i < 40 else 5}\tC\t{5 if 20 <= i < 40 else 0}\n" for i in range(60)))
    stream = calls.stream_counts(spark, str(src))
    q = calls.stream_ancestry(stream, str(tmp_path / "out"), str(tmp_path / "ck"), design="BC2S3")
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.groupBy("name").count().count() == 3 and got.where("state = 2").count() == 3
    g = calls.stream_genotypes(stream).writeStream.format("memory").queryName("g").trigger(availableNow=True).start()
    g.awaitTermination(120)
    assert spark.table("g").where("g = 2").count() == 60
    with pytest.raises(ValueError):
        calls.stream_genotypes(stream, "hwe")
