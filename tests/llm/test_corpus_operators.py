import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaic_spark.llm import common, exact_dedup, lsh_forest, mixing, nn_descent, packing, suffix_radix, token_counts
from mosaic_spark.llm.common import components

from ..conftest import rows
from . import brute, corpora


@pytest.fixture(scope="module")
def docs(spark):
    data = corpora.corpus()
    return data, spark.createDataFrame(data, corpora.SCHEMA).repartition(3).cache()


def test_exact_dedup_matches_plain_version(docs):
    data, df = docs
    got = exact_dedup.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(got) == sorted(brute.exact(data), key=repr)


def test_exact_dedup_odd_tables(spark):
    empty = spark.createDataFrame([], corpora.SCHEMA)
    assert exact_dedup.exact_dedup(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b", "k"), (1, "a b", "k"), (None, "ab", "n"), (2, None, "z")], "doc_id long, text string, keep_id string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()}
    assert got == {(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False), (2, 2, 1, True)}
    marks = [r.kept for r in exact_dedup.exact_dedup(odd).collect()]
    assert sum(marks) == 2 and exact_dedup.drop_exact_copies(odd).count() == 2
    same = spark.createDataFrame([(1, "a b"), (1, "a  b"), (1, "ab"), (None, "q"), (None, "q ")], corpora.SCHEMA)
    assert sorted(r.text for r in exact_dedup.exact_dedup(same).where("kept").collect()) == ["a  b", "q "]
    assert sorted(r.text for r in exact_dedup.drop_exact_copies(same).collect()) == ["a  b", "q "]
    assert exact_dedup.drop_exact_copies(odd).columns == ["doc_id", "text", "keep_id"]


def test_directory_doubles_only_full_buckets():
    cells = [(0, 50), (1, 60), (1 << 15, 5)]
    found = exact_dedup.double_directory(cells, 60, 0)
    assert (1 << 15, 1) in found and len(found) == exact_dedup.MAX_DEPTH + 1
    assert sum(1 << (exact_dedup.MAX_DEPTH - local) for _, local in found) == 1 << exact_dedup.MAX_DEPTH


def test_small_buckets_give_the_same_result(docs):
    _, df = docs
    one, many = (rows(exact_dedup.exact_dedup(df, bucket_entries=k).select("doc_id", "keep_id")) for k in (10**6, 4))
    assert one == many
    index = exact_dedup.build_index(df, bucket_entries=4)
    owned = index.entries.withColumn("f", F.input_file_name()).groupBy("__bucket").agg(F.min("__key").alias("lo"), F.max("__key").alias("hi"), F.count("*").alias("n"), F.countDistinct("f").alias("owners")).collect()
    assert len(owned) > 4 and max(r.n for r in owned) <= 4 and {r.owners for r in owned} == {1}
    ranges = sorted((r.lo % 2**64, r.hi % 2**64) for r in owned if (r.lo < 0) == (r.hi < 0))
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert {r.doc_id for r in exact_dedup.drop_exact_copies(df).collect()} == {i for i, k in one if i == k}


def test_near_dedup_matches_plain_version(docs):
    data, df = docs
    assert rows(lsh_forest.near_dedup(df)) == sorted(brute.near(data), key=repr)


@pytest.mark.parametrize("region_rows", [2, 5])
def test_deep_regions_keep_links_of_close_copies(spark, region_rows):
    import random

    rng = random.Random(3)
    base = corpora.words(rng, 300)
    data = []
    for i in range(40):
        w = list(base)
        if i:
            w[rng.randrange(300)] = f"w{i}"
        data.append((i, " ".join(w)))
    got = lsh_forest.near_dedup(spark.createDataFrame(data, corpora.SCHEMA), region_rows=region_rows)
    assert {r.component_id for r in got.collect()} == {0}


def test_star_whose_leaves_do_not_link(spark):
    """Leaves link with the centre alone, so each needs that one pair."""
    import random

    rng = random.Random(5)
    base = corpora.words(rng, 400)
    data = [(100, " ".join(base))]
    for i in range(12):
        w = list(base)
        for p in rng.sample(range(0, 395, 6), 9):
            w[p] = f"leaf{i}x{p}"
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, corpora.SCHEMA)
    assert rows(lsh_forest.near_dedup(df)) == sorted(brute.near(data), key=repr)


def _one_region(spark, texts, region_rows):
    """Components of texts that share the region of one tree, with signatures that
    agree nowhere: deeper parts and prefix neighbours bring no pair."""
    rng = np.random.default_rng(8)
    rows = [(i, len(brute.shingles(t)), [77] + [1000 + 40 * i + k for k in range(lsh_forest.TREES - 1)], rng.bytes(lsh_forest.VALUES)) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame([(i, n, k, bytearray(s)) for i, n, k, s in rows], "id long, n long, keys array<long>, sig binary")
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    comp = lsh_forest.near_links(nodes, lambda ids: table.join(ids, "id"), region_rows=region_rows)
    found = dict(map(tuple, comp.collect()))
    return {i: found.get(i, i) for i in range(len(texts))}


def _edited(words, places, name):
    return " ".join(f"{name}x{p}" if p in places else w for p, w in enumerate(words))


@pytest.mark.parametrize("region_rows", [3, 10**6])
def test_oversized_region_keeps_links_away_from_its_smallest_id(spark, region_rows):
    import random

    rng = random.Random(6)
    base = corpora.words(rng, 400)
    texts = [_edited(base, set(range(i % 7, 395, 9)), f"t{i}") for i in range(10)]
    for k in (4, 7):
        texts.append(_edited(texts[k].split(), set(range(3, 395, 41)), f"copy{k}"))
    want = {i: root for i, _, root, _ in brute.near(list(enumerate(texts)))}
    assert want[10] == 4 and want[11] == 7 and want[0] == 0 and len(set(want.values())) == 10
    assert _one_region(spark, texts, region_rows) == want


def test_link_beyond_the_first_partners_when_the_largest_component_changes(spark):
    """Node 0 stands for the largest component in the first round, as all have one
    node; its only partner has 39 nearer ones."""
    import random

    base = corpora.words(random.Random(7), 400)
    spots = set(range(5, 375, 35))
    texts = [_edited(base, spots, "zero"), " ".join(base), *(_edited(base, {p}, "near") for p in [p for p in range(12, 390, 3) if all(abs(p - q) > 5 for q in spots)][:39])]
    want = {i: root for i, _, root, _ in brute.near(list(enumerate(texts)))}
    assert len(texts) == 41 and set(want.values()) == {0}
    assert _one_region(spark, texts, 10**6) == want


def test_near_dedup_odd_tables(spark):
    assert lsh_forest.near_dedup(spark.createDataFrame([], corpora.SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, "")], corpora.SCHEMA)
    got = sorted(map(tuple, lsh_forest.near_dedup(odd).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)], key=repr)
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:50], f"x{k}", *words[51:]]) for k in range(3)]
    other = " ".join(f"o{k}" for k in range(30))
    mixed = [(7, near[0], "a"), (None, near[1], "b"), (None, near[2], "c"), (7, other, "d"), (None, "alone " * 9, "e"), (8, other + " end", "f")]
    table = spark.createDataFrame(mixed, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_dedup(table).collect()), key=repr)
    assert got == sorted([(7, 56, 7, True), (None, 56, 7, False), (None, 56, 7, False), (7, 26, 7, True), (None, 1, None, True), (8, 27, 7, False)], key=repr)
    kept = lsh_forest.drop_near_copies(table)
    assert kept.columns == table.columns and sorted(r.component_id for r in kept.collect()) == ["a", "d", "e"]


@pytest.mark.parametrize("hot,few", [(200_000, 10**6), (3, 10**6), (200_000, 0), (3, 0)])
def test_suffix_dedup_matches_plain_version(docs, hot, few):
    data, df = docs
    got = suffix_radix.suffix_dedup(df, hot_rows=hot, few=few).drop("kept_bytes")
    assert rows(got) == sorted(brute.suffixes(data), key=repr)


def test_suffix_dedup_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_radix, "AT_ONCE", 256)
    monkeypatch.setattr(suffix_radix, "_LOW", np.uint64(511))
    data = corpora.corpus(2, 24)
    texts = [((t or "").encode()) for _, t in data]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    windows = set()
    for row, first, last, anchor, _ in suffix_radix.anchor_runs(raw, off):
        for r, f, t, a in zip(row, first, last, anchor):
            assert off[r] <= f <= t and t + 100 <= off[r + 1] and f <= a + 0 and a <= t + 76
            windows |= set(range(f, t + 1))
    assert windows == {p for i, t in enumerate(texts) for p in range(off[i], off[i] + len(t) - 99)}


def test_windows_of_one_hash_are_told_apart_by_bytes(docs, monkeypatch):
    """A hash of a window's first byte alone: only bytes tell windows apart."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 130, np.uint8).tobytes()
    other = text[:60] + b"z" + text[61:]
    plain, weak = suffix_radix.gram_hashes, lambda raw, width: raw[: len(raw) - width + 1].astype(np.uint64)
    cols = [pa.array([5] * 3, pa.int64()), pa.array([0] * 3, pa.int32()), pa.array([text, other, text], pa.binary()), pa.array([1, 2, 3], pa.int64()), pa.array([1, 2, 3], pa.int64()), pa.array([0] * 3, pa.int64())]
    batch = pa.RecordBatch.from_arrays(cols, names=["key", "lo", "ctx", "doc_id", "rid", "pos"])
    want = [b.to_pylist() for b in suffix_radix._firsts(iter([batch]))]
    monkeypatch.setattr(suffix_radix, "gram_hashes", weak)
    assert [b.to_pylist() for b in suffix_radix._firsts(iter([batch]))] == want
    assert plain is not weak and any(any(r["bits"]) for r in want[0])


def test_suffix_sort_works_in_small_blocks():
    """8 MB of contexts took 380 MB while they were sorted; two such tasks share an executor."""
    import pyarrow as pa

    n, rng = 60_000, np.random.default_rng(4)
    raw = rng.integers(97, 123, n * 140, dtype=np.uint8).tobytes()
    number = pa.array(np.arange(n))
    ctx = pa.array([raw[i : i + 140] for i in range(0, len(raw), 140)], pa.binary())
    batch = pa.RecordBatch.from_arrays([number, pa.array(np.zeros(n, np.int32)), ctx, number, number, pa.array(np.zeros(n, np.int64))], names=["key", "lo", "ctx", "doc_id", "rid", "pos"])
    tracemalloc.start()
    got = sum(len(b) for b in suffix_radix._firsts(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == n and peak < 200e6


def test_suffix_dedup_odd_tables(spark):
    assert suffix_radix.suffix_dedup(spark.createDataFrame([], corpora.SCHEMA)).count() == 0
    t = "0123456789" * 12
    got = {(r.doc_id, r.n_removed) for r in suffix_radix.suffix_dedup(spark.createDataFrame([(None, t), (5, t), (5, t), (6, None)], corpora.SCHEMA)).collect()}
    assert got == {(5, 110), (None, 120), (6, 0)}


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(c):
            out.append((centre + rng.standard_normal(16) * 0.25).tolist())
    out += [out[3], out[3], [0.0] * 16, None, [float("nan")] * 16, [], [1.0, None], [3.0] * 4, [6.0] * 4]
    return list(enumerate(out))


def test_embedding_dedup_matches_plain_version(spark):
    data = vectors()
    got = nn_descent.embedding_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert rows(got) == sorted(brute.embeddings(data), key=repr)


def test_embedding_blocks_of_large_components(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, (np.ones(8) + rng.standard_normal(8) * 0.15).tolist()) for i in range(90)]
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    got = nn_descent.embedding_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert rows(got) == sorted(brute.embeddings(data), key=repr)


def test_embedding_groups_with_full_lists_are_joined(spark):
    """Two tight groups: every list fills up inside, links across are below those."""
    rng = np.random.default_rng(9)
    a, b, *_ = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    turned = 0.968 * a + np.sqrt(1 - 0.968**2) * b
    noise = lambda c: c + rng.standard_normal(16) * 0.018
    data = [(i, noise(a if i % 2 else turned).tolist()) for i in range(120)]
    want = sorted(brute.embeddings(data), key=repr)
    assert {r[2] for r in want} == {0} and min(r[1] for r in want) > 60
    assert rows(nn_descent.embedding_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>"))) == want


def test_embedding_audit_counts_small_groups(spark):
    """One hot group is found, five pairs are lost."""
    rng = np.random.default_rng(10)
    unit = lambda v: (v / np.linalg.norm(v)).tobytes()
    hot, pairs = rng.standard_normal(16), [rng.standard_normal(16) for _ in range(5)]
    vec = [unit(hot + rng.standard_normal(16) * 0.01) for _ in range(200)] + [unit(p + rng.standard_normal(16) * 0.01) for p in pairs for _ in "ab"]
    nodes = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(vec)], "id long, v binary")
    found = spark.createDataFrame([(i, 0) for i in range(200)], "id long, component long")
    assert nn_descent._audit(nodes, found, 0.95, nn_descent.AUDIT) < 0.6


def test_embedding_rows_that_share_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = [1.0, 0.1, 0.0]
    data = [(1, a, "x"), (1, b, "y"), (None, near, "z"), (None, [0.0, 0.0, 1.0], "u"), (2, near, "v")]
    got = nn_descent.embedding_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>, component_id string"))
    assert rows(got) == sorted([(1, 2, 1, True), (1, 0, 1, True), (None, 2, 1, False), (None, 0, None, True), (2, 2, 1, False)], key=repr)


def test_embedding_threshold_tie(spark):
    """Cosine 0.95 to the last bit links, the next smaller one does not."""
    data = [(1, [1.0, 0.0]), (2, [0.95, float(np.sqrt(1 - 0.95**2))]), (3, [-1.0, 0.0]), (4, [-0.9499, float(np.sqrt(1 - 0.9499**2))])]
    x = np.array(data[1][1])
    x /= np.sqrt(x @ x)
    linked = bool(x[0] >= 0.95)
    got = {r.vec_id: r.n_links for r in nn_descent.embedding_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: int(linked), 2: int(linked), 3: 0, 4: 0}


def test_embedding_empty(spark):
    assert nn_descent.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("task_edges", [10**6, 20])
def test_components_of_paths_and_stars(spark, monkeypatch, task_edges):
    import random

    monkeypatch.setattr(common, "TASK_EDGES", task_edges)

    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1040)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1040)} == {1000} and 5000 not in got


def test_mixing_targets_and_positions(spark):
    rng = np.random.default_rng(1)
    data = [(i, "w " * int(n), f"s{s}" if s < 5 else None) for i, (n, s) in enumerate(zip(rng.integers(0, 40, 600), rng.integers(0, 6, 600)))]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_report(df).collect()
    total = sum(r["size"] for r in got)
    by = {r.source: r.target for r in mixing.targets(df.select("source", mixing.words(df.text).alias("size"))).collect()}
    assert abs(sum(by.values()) - 1.5 * total) < 1e-6
    taken, order = {}, [r.position for r in got if r.position is not None]
    names = dict((i, s) for i, _, s in data)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and (r.position is None) == (r.taken == 0)
        taken[names[r.doc_id]] = taken.get(names[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - by[s]) <= 40 for s in by)
    assert order == sorted(order) and max(order) < 1
    assert rows(mixing.mix_report(df.repartition(5))) == rows(mixing.mix_report(df))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def test_mixing_odd_tables(spark):
    assert mixing.mix_report(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    got = mixing.mix_report(spark.createDataFrame([(1, None, None), (None, "a b", None), (2, "", "s")], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r["size"], r.taken) for r in got} <= {(1, 0, 0), (None, 2, 2), (None, 2, 4), (2, 0, 0)}


def encoded(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text, add_special_tokens=False).ids


TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>don't<|endoftext|>\n", "<|endoftext|", "", " ", "Hello  world\n\n  don't stop", "a b 　 c\x1cd\x85e", "naïve café 12345 &&& \t\t x", "ends \n", "\n\nfoo bar", "日本語 テキスト 🙂🙂", "  lead", "a" * 300, "x\r\ny  \r\n z"]


def test_encoder_equals_the_tokenizer():
    from mosaic_spark.llm.tokens import Encoder

    texts = TEXTS + [t for _, t in corpora.corpus() if t]
    enc = Encoder()
    for _ in range(2):  # the second time all chunks are known
        ids, bounds = enc.encode(texts)
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == encoded(t), t[:40]


def test_encoder_cuts_long_texts_safely(monkeypatch):
    from mosaic_spark.llm import tokens

    monkeypatch.setattr(tokens, "AT_ONCE", 50)
    text = "  many words\nin 1 long   text, " * 30
    ids, bounds = tokens.Encoder().encode(["a b", text, "c"])
    assert ids[bounds[1] : bounds[2]].tolist() == encoded(text) and bounds[-1] == len(ids)


def test_token_counts(docs, spark):
    data, df = docs
    lengths = [len(encoded(t or "")) for _, t in data]
    table = token_counts.length_table(df)
    for r in table.collect():
        assert r.docs == lengths.count(r.n_tokens) and r.tokens_at_least == sum(x for x in lengths if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert abs(r.quantile - sum(x <= r.n_tokens for x in lengths) / len(lengths)) < 1e-12
    assert token_counts.truncated_total(table, 17).first()[0] == sum(min(x, 17) for x in lengths)
    assert token_counts.length_table(spark.createDataFrame([], corpora.SCHEMA)).count() == 0


def test_packing_tiers_and_steps():
    rng = np.random.default_rng(12)
    packer = packing.Packer(0, 64, 1024)
    sizes = [int(x) for x in np.concatenate([rng.integers(1, 33, 900), rng.integers(9, 64, 300), [64, 130, 1]])]
    for i, n in enumerate(rng.permutation(sizes)):
        packer.add(i, np.full(n, i, np.uint16))
    packer.finish()
    by_seq, by_step = {}, {}
    for doc, start, n, _, total, seq, at, tier, step in packer.out:
        by_seq.setdefault(seq, []).append((at, n, tier, step))
    for pieces in by_seq.values():
        at, n, tier, step = min(pieces)
        by_step.setdefault(step, []).append(tier)
        assert sum(p[1] for p in pieces) == tier
    tiers = [t for ts in by_step.values() for t in ts]
    assert sum(tiers) == sum(sizes) and all(tiers.count(t) > 5 for t in (16, 32, 64))
    opened = [min(p) for p in by_seq.values() if min(p)[2] in (16, 32, 64)]
    assert np.mean([packing.tier_of(n, 64) == tier for _, n, tier, _ in opened]) > 0.95  # own tier opens it
    full = [ts for ts in by_step.values() if sum(ts) == 64 * packing.STEP_WINDOWS]
    assert len(full) >= len(by_step) - packing.OPEN_STEPS and max(sum(ts) for ts in by_step.values()) == 64 * packing.STEP_WINDOWS


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "c d e", 6), (None, None, 7), (2, "", 8)], "doc_id long, text string, length int")
    got = packing.pack(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in got if r.start == 0) == [(False, 1, 3), (False, 1, 4), (False, 2, 1), (True, 0, 1)]
    assert sum(r.length for r in got) == 9


def test_packing_round_trip(docs, spark):
    import zlib

    data, df = docs
    got = packing.pack(df, limit=64, pool_tokens=512).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in data:
        ids, at = [*encoded(t or ""), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and at & (at - 1) == 0  # nothing is padded
        assert {p.tier for p in pieces} == {at} and len({p.step for p in pieces}) == 1
    assert packing.pack(spark.createDataFrame([], corpora.SCHEMA)).count() == 0
