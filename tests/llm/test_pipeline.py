import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from . import brute, corpora  # noqa: E402
from .test_pages_and_labels import labelled  # noqa: E402


def test_stages_against_plain_versions(spark, tmp_path):
    train = labelled(1, 600)
    docs = [(i, t, f"s{i % 4}") for i, t, _ in train] + [(1000 + i, t, "c") for i, t in corpora.corpus()]
    table = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in train], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    toxic = {i for i, _, x in train if x}
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == table.columns
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = now
    ids = lambda n: sorted(r.doc_id for r in kept[n].select("doc_id").collect())
    left = [(i, t) for i, t, _ in docs if i not in toxic]
    assert ids("toxicity") == [i for i, _ in left]
    first = {x[0] for x in brute.exact(left) if x[3]}
    left = [r for r in left if r[0] in first]
    assert ids("exact_dedup") == sorted(i for i, _ in left)
    stay = {x[0] for x in brute.near(left) if x[3]}
    assert ids("minhash_near_dedup") == sorted(stay)
    mixed = ids("mixing")
    assert set(mixed) <= stay and max(mixed.count(i) for i in set(mixed)) <= 2
    assert sum(1 for r in kept["packing"].collect() if r.start == 0) == len(mixed)
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length").collect()))
