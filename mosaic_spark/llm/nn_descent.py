"""Embedding near-dedup with NN-descent.

Equal vectors collapse to one node with a multiplicity first. A neighbour graph is
seeded from several orders of random-hyperplane signatures, then refined: around
every node its neighbours and reverse neighbours meet (neighbours of neighbours),
and each keeps its best partners. Rounds go on until few lists change; an audit
compares a bounded sample of vectors, one of a component, with all rows and averages
their recall. Seeds double and rounds go on while it is below ``recall``; if it stays
below, that is an error.

Edges at the threshold give components. A list that is full of such edges hides what
lies beyond, so every node also keeps its best partners outside its component, and
the components are joined until no such list is full. Counts of direct links are exact
inside components, by matrix products of a block of members with a stream of all
members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, components, delete, whole_groups

COSINE = 0.95
NEIGHBOURS, ORDERS, REACH = 12, 12, 6
#: Components whose vectors the audit compares with all rows.
AUDIT = 4096
#: Rounds end when fewer of the lists' edges than this share are new, or after so many.
CHANGED, ROUNDS = 0.01, 8
BLOCK = 2048


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for b in batches:
        ids, vec, name = [], [], []
        for x in b.column(1):
            v = None if x.as_py() is None or x.values.null_count else np.asarray(x.values, np.float64)
            top = np.abs(v).max() if v is not None and len(v) and np.isfinite(v).all() else 0.0
            if top > 0:
                v = v / top  # no overflow or underflow in the norm
                vec.append((v / np.sqrt(v @ v)).tobytes())
                name.append(xxh3_128_digest(np.asarray(x.values, np.float64).tobytes()))
            else:
                vec.append(None), name.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.binary()), pa.array(name, pa.binary())], names=["vec_id", "v", "name"])


def _matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _signatures(seed: int, orders: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = [len(x) for x in b.column(1).to_pylist()]
            for width in sorted(set(dims)):
                rows = b.filter(pa.array([d == width for d in dims]))
                m = _matrix(rows.column(1))
                rng = np.random.default_rng((seed, m.shape[1]))
                for o in range(orders):
                    bits = (m @ rng.standard_normal((m.shape[1], 60))) > 0
                    key = bits @ (1 << np.arange(59, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), width * 1000 + o), pa.int64()), pa.array(key), *rows.columns], names=["o", "key", "id", "v", "c"])

    return run


def _neighbours(reach: int, keep: int):
    """Of rows (o, key, id, v, c) in order: each row's ``keep`` best partners, and as many
    of other components c, among the ``reach`` rows after and before it, within a
    partition and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            if not len(b):
                continue
            if tail is not None:
                b = pa.Table.from_batches([tail, b]).combine_chunks().to_batches()[0]
            o, ids, comp = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 4))
            tail = b.slice(max(0, len(b) - reach))
            for width in np.unique(o // 1000):
                at = np.flatnonzero(o // 1000 == width)
                m, oo, ii, cc = _matrix(b.column(3).take(pa.array(at))), o[at], ids[at], comp[at]
                n = len(at)
                sim, same = np.full((2 * reach, n), -2.0), np.zeros((2 * reach, n), bool)
                for d in range(1, min(reach, n - 1) + 1):
                    s = np.einsum("ij,ij->i", m[:-d], m[d:])
                    s[oo[:-d] != oo[d:]] = -2.0
                    sim[d - 1, :-d] = s
                    sim[reach + d - 1, d:] = s
                    same[d - 1, :-d] = same[reach + d - 1, d:] = cc[:-d] == cc[d:]
                for sim in (sim, np.where(same, -2.0, sim)) if same.any() else (sim,):
                    best = np.argsort(-sim, axis=0)[:keep]
                    step = np.where(best < reach, best + 1, reach - 1 - best)
                    s = np.take_along_axis(sim, best, 0)
                    a = np.broadcast_to(np.arange(n), s.shape)
                    ok = s > -2.0
                    yield _edges(ii[a[ok]], ii[np.clip(a + step, 0, n - 1)[ok]], s[ok])

    return run


def _edges(a, b, s) -> pa.RecordBatch:
    keep = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64()), pa.array(s[keep], pa.float64())], names=["a", "b", "s"])


def _local_join(keep: int):
    """Around each centre, of rows (centre, id, v, c): every member's best partners, and
    its best of other components c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in whole_groups(batches):
            ids, comp = (whole.column(c).to_numpy(zero_copy_only=False) for c in (1, 3))
            out = []
            for i, j in zip(at[:-1], at[1:]):
                m = whole.column(2).slice(i, j - i)
                if j - i < 2 or len({len(x) for x in m.to_pylist()}) > 1:
                    continue
                m = _matrix(m)
                s = m @ m.T
                np.fill_diagonal(s, -2.0)
                k = min(keep, j - i - 1)
                same = comp[i:j, None] == comp[None, i:j]
                for s in (s, np.where(same, -2.0, s)) if same.sum() > j - i else (s,):
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    rows = np.repeat(np.arange(j - i), k)
                    found = s[rows, top.ravel()]
                    ok = found > -2.0
                    out.append((ids[i:j][rows[ok]], ids[i:j][top.ravel()[ok]], found[ok]))
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out)))

    return run


def _best(edges: DataFrame, k: int, comp: DataFrame | None = None) -> DataFrame:
    """The ``k`` best partners of every node, and its ``k`` best outside its component. The
    rank filter is pushed below the exchange as a group limit, so a hub sends at most
    2k rows from each task."""
    both = edges.groupBy("a", "b").agg(F.max("s").alias("s"))
    if comp is None:
        both = both.withColumn("out", F.lit(True))
    else:
        ca, cb = (comp.select(F.col("id").alias(c), F.col("component").alias("c" + c)) for c in "ab")
        both = both.join(ca, "a", "left").join(cb, "b", "left").withColumn("out", F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "s", "out")
    order = Window.partitionBy("a", "out").orderBy(F.col("s").desc(), "b")
    return both.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("a", "b", "s", "out")


def _round(graph: DataFrame, nodes: DataFrame, k: int, comp: DataFrame | None) -> DataFrame:
    edges = graph.select("a", "b", "s")
    reverse = _best(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"), k, comp)
    around = edges.unionByName(reverse.select("a", "b", "s")).select(F.col("a").alias("centre"), F.col("b").alias("id")).unionByName(nodes.select(F.col("id").alias("centre"), "id")).distinct()
    rows = around.join(nodes, "id").select("centre", "id", "v", "c").repartition("centre").sortWithinPartitions("centre", "id")
    return _best(edges.unionByName(rows.mapInArrow(_local_join(3), "a long, b long, s double")), k, comp)


def _audit(nodes: DataFrame, links: DataFrame, cosine: float, size: int, seed: int = 0) -> float:
    """Mean, over sampled vectors with true links, of the share of a vector's links whose two
    ends the found edges put into one component. A sampled vector is one of its
    component, so that a large group counts once and small ones as they are many; the
    sample is bounded, its rows are compared with every node in one streaming pass."""
    named = nodes.select("id", "v").join(links, "id", "left").withColumn("component", F.coalesce("component", "id"))
    one = named.groupBy("component").agg(F.min_by(F.struct("id", "v"), F.xxhash64("id", F.lit(seed))).alias("x"))
    sample = one.orderBy(F.xxhash64("component", F.lit(seed))).limit(size).select("x.id", "x.v").collect()
    ids, vec = np.array([r.id for r in sample]), [bytes(r.v) for r in sample]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1000):
                b = whole.slice(start, 1000)
                other, raw = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
                for width in {len(x) for x in raw}:
                    at = np.flatnonzero([len(x) == width for x in raw])
                    q = np.flatnonzero([len(x) == width for x in vec])
                    if len(q):
                        s = np.frombuffer(b"".join(vec[i] for i in q)).reshape(len(q), -1) @ np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1).T
                        x, y = np.nonzero(s >= cosine)
                        yield _edges(ids[q[x]], other[at[y]], s[x, y])

    true = nodes.select("id", "v").mapInArrow(run, "a long, b long, s double")
    ca, cb = (links.select(F.col("id").alias(c), F.col("component").alias("c" + c)) for c in "ab")
    each = true.join(ca, "a", "left").join(cb, "b", "left").groupBy("a").agg(F.avg(F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("int")).alias("share"))
    share = each.agg(F.avg("share")).first()[0]
    return 1.0 if share is None else share


def _counts(cosine: float):
    """Of rows (part, base, id, v, m), a part's own rows before its base rows: the
    multiplicities within the threshold of each own row. Base rows are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, ids, links, mat = None, [], [], None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], names=["id", "links"])

        for b in batches:
            key, base = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (base[1:] != base[:-1])) + 1, [len(key)]]) if len(key) else [0]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if key[i] != part:
                    if links is not None:
                        yield done()
                    part, own, ids, links = key[i], [], [], None
                m = _matrix(b.column(3).slice(i, j - i))
                if not base[i]:
                    own.append(m)
                    ids += b.column(2).slice(i, j - i).to_pylist()
                    continue
                if links is None:
                    mat, links = np.concatenate(own), np.zeros(len(ids), np.int64)
                weight = b.column(4).slice(i, j - i).to_numpy(zero_copy_only=False)
                for x in range(0, len(m), BLOCK):
                    links += (mat @ m[x : x + BLOCK].T >= cosine) @ weight[x : x + BLOCK]
        if links is not None:
            yield done()

    return run


def link_graph(nodes: DataFrame, cosine: float = COSINE, k: int = NEIGHBOURS, orders: int = ORDERS, recall: float = 0.999, most_rounds: int = 4, seed: int = 11) -> tuple[DataFrame, float]:
    """((id, component) of nodes with a link, audited recall) of nodes (id, v). An audit
    below ``recall`` after all attempts, or lists still full of links, is an error."""
    tables = Tables(nodes.sparkSession, "link-graph")
    graph, comp, links, share, attempt, full = None, None, None, 0.0, 0, False
    while attempt < most_rounds:
        known = nodes.select("id", "v") if comp is None else nodes.select("id", "v").join(comp, "id", "left")
        known = tables.put(known.select("id", "v", (F.col("id") if comp is None else F.coalesce("component", "id")).alias("c")))
        rows = known.mapInArrow(_signatures(seed + attempt, orders << attempt), "o long, key long, id long, v binary, c long")
        rows = rows.repartitionByRange("o", "key", "id").sortWithinPartitions("o", "key", "id")
        seeds = rows.mapInArrow(_neighbours(REACH, 4), "a long, b long, s double")
        graph = tables.put(_best(seeds if graph is None else seeds.unionByName(graph.select("a", "b", "s")), k, comp))
        for _ in range(ROUNDS):
            last, graph = graph, tables.put(_round(graph, known, k, comp))
            settled = graph.join(last, ["a", "b"], "left_anti").count() <= CHANGED * graph.count()
            tables.drop(last)
            if settled:
                break
        new = graph.where(F.col("s") >= cosine).select("a", "b")
        full = bool(graph.where("out").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("least")).where((F.col("n") >= k) & (F.col("least") >= cosine)).limit(1).count())
        links = new if comp is None else new.unionByName(comp.select(F.col("id").alias("a"), F.col("component").alias("b")))
        comp = components(links)
        share = _audit(nodes, comp, cosine, AUDIT, seed + attempt)
        attempt += 1
        if share >= recall and not full:
            delete(nodes.sparkSession, [tables.path])
            return comp, share
    raise RuntimeError(f"link_graph: audited recall {share:.5f} of {recall} after {attempt} attempts; full neighbour lists: {full}")


def embedding_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vector.

    Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing; vectors of different lengths do not link. Equal vectors link with
    each other. A distinct vector is a node of its own, whatever its rows' ids: rows that
    repeat an id count each as a vector. A null id ranks last; a component of such rows
    alone has a null id. An empty table gives an empty result."""
    tables = Tables(vectors.sparkSession, "embedding-dedup")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    base = tables.put(rows.mapInArrow(_unit, "vec_id long, v binary, name binary"))
    classes = base.where("name IS NOT NULL").groupBy("name").agg(F.min("vec_id").alias("least"), F.first("v").alias("v"), F.count(F.lit(1)).alias("m"))
    nodes = tables.put(classes.select("name", F.monotonically_increasing_id().alias("id"), "least", "v", "m"))
    comp, _ = link_graph(nodes.select("id", "v"), cosine)
    member = tables.put(nodes.join(comp, "id").select("id", "component", "v", "m", "least"))
    size = member.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.min("least").alias("first"))
    blocked = member.select("id", "component", "v", "m").join(size.select("component", "parts"), "component")
    own = blocked.withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("base", F.lit(0))
    every = blocked.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("base", F.lit(1))
    blocks = own.unionByName(every).select(F.xxhash64("component", "p").alias("part"), "base", "id", "v", "m")
    counts = blocks.repartition("part").sortWithinPartitions("part", "base", "id").mapInArrow(_counts(cosine), "id long, links long")
    linked = member.select("id", "component").join(size.select("component", "first"), "component").join(counts, "id").select("id", "first", "links", F.lit(True).alias("in"))
    named = nodes.select("id", "name", "least", "m").join(linked, "id", "left")
    named = named.select(F.col("name").alias("__name"), F.when(F.col("in"), F.col("first")).otherwise(F.col("least")).alias("component"), F.coalesce("links", "m").alias("links"))
    out = base.select("vec_id", "name").join(named, F.col("name") == F.col("__name"), "left")
    out = out.select("vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """The vectors that stay, with their columns."""
    kept = embedding_dedup(vectors).where("kept").select(F.col("vec_id").alias("__id")).distinct()
    return vectors.join(kept, F.col("vec_id").eqNullSafe(F.col("__id"))).drop("__id")
