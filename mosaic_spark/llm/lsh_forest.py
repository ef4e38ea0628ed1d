"""MinHash near-dedup with an LSH forest.

Sets. A document is the set of its distinct 5-word shingles (64-bit hashes of
whole texts). Identical sets collapse to one node before anything is compared.

Forest. 128 MinHash values make 32 trees; a tree is a sorted signature order and
a region of it the nodes that share the first four values. A pair at similarity
0.75 misses every region with probability (1 - 0.75**4)**32 < 1e-5. To find
neighbours, a region of more than ``region_rows`` nodes goes deeper by further values
until it fits; its smallest node stays a member of every part. Its other pairs are
reached in the region itself, dealt as blocks.

Candidates. Longest-common-prefix neighbours in each order come first. Each node
checks its best neighbour, then neighbours that are still in another component.
After that only nodes outside the largest component of a region remain: they meet
the others of their region in order of estimated similarity, the nearest first and then
all, until no pair of different components is left. So a group of m copies
costs about m checks and no link between components is left out. In a region of more
than ``region_rows`` nodes, blocks of these open nodes meet blocks of all its nodes,
each pair of blocks in a task of its own.

Checks compare full shingle sets: 100 * intersection >= 75 * union."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, components, delete, slices, text_buffers, whole_groups

SHINGLE, TREES, DEPTH = 5, 32, 4
VALUES = TREES * DEPTH
#: Values of the wide signatures that candidates get beside their sets.
WIDE = 512
SIMILARITY = 75
#: Pairs whose estimated similarity is below go unchecked: 4 standard errors under 0.75,
#: for signatures of VALUES and of WIDE bytes.
LEAST_ESTIMATE, LEAST_WIDE = 0.6, 0.675
REGION_ROWS = 20_000
_rng = np.random.default_rng(7)
_A, _B = _rng.integers(1, 2**63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 2**63, WIDE, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 ``text``;
    ASCII case is folded and words are split at ASCII white space only."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = mixed(np.fromiter(map(xxh64_intdigest, words), np.uint64, n))
    width = min(n, shingle)
    h = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        h = h * _P + w[j : n - width + 1 + j]
    return np.unique(mixed(h))


def minhash(values: np.ndarray, n: int = VALUES) -> np.ndarray:
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):
        part = values[i : i + 1024]
        np.minimum(least, (part[None, :] * _A[:n, None] + _B[:n, None]).min(axis=1), out=least)
    return mixed(least)


def signature(least: np.ndarray) -> bytes:
    return (least >> np.uint64(56)).astype(np.uint8).tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    salt = mixed(np.arange(1, TREES + 1, dtype=np.uint64))
    for b in batches:
        raw, off = text_buffers(b.column(1))
        for i, j in slices(off, 8_000_000):
            sizes, ids, keys, sigs = [], [], [], []
            part = b.slice(i, j - i)
            for k in range(i, j):
                s = shingle_set(raw[off[k] : off[k + 1]].tobytes())
                sizes.append(len(s))
                if not len(s):
                    ids.append(None), keys.append(None), sigs.append(None)
                    continue
                m = minhash(s)
                ids.append(xxh3_128_digest(s.tobytes()))
                tree = salt.copy()
                for d in range(DEPTH):
                    tree = mixed(tree * _P + m.reshape(TREES, DEPTH)[:, d])
                keys.append(tree.view(np.int64))
                sigs.append(signature(m))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), part.column(2)], names=["doc_id", "n_shingles", "set_id", "keys", "sig", "text_id"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = text_buffers(b.column(1))
        for i, j in slices(off, 8_000_000):
            sets = [shingle_set(raw[off[k] : off[k + 1]].tobytes()) for k in range(i, j)]
            wide = [signature(minhash(x, WIDE)) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(wide, pa.binary())], names=["id", "s", "wide"])


def _checked(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, xo), (y, yo) = text_buffers(b.column(2)), text_buffers(b.column(3))
            keep = np.zeros(len(b), bool)
            for i in range(len(b)):
                s, t = np.frombuffer(x[xo[i] : xo[i + 1]].tobytes(), np.uint64), np.frombuffer(y[yo[i] : yo[i + 1]].tobytes(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] = 100 * both >= similarity * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep)], names=["a", "b", "linked"])

    return run


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal signature bytes of every row of ``a`` with every row of ``b``:
    eight at a time, summed inside 64-bit words. For at most 248 bytes."""
    out = np.zeros((len(a), len(b)), np.uint64)
    x, y = (np.ascontiguousarray(m).reshape(len(m), -1, 8).transpose(1, 0, 2) for m in (a, b))
    for k in range(len(x)):
        out += (np.ascontiguousarray(x[k])[:, None, :] == np.ascontiguousarray(y[k])[None, :, :]).view(np.uint64)[:, :, 0]
    return ((out * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.float32) / a.shape[1]


def _near_sizes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(x, y) >= SIMILARITY * np.maximum(x, y)


#: Members whose mean estimate to a spread of others is highest: where copies link to
#: their original alone, it is among these. Spread and number of them, for a region.
SPREAD, CENTRES = 48, 12


def _neighbour_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of regions, rows (key, tree, id, sig): longest-common-prefix neighbours, and for
    every node its best of the region's central members."""
    for whole, at in whole_groups(batches):
        tree, ids = (whole.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
        sigs = text_buffers(whole.column(3))[0].reshape(-1, VALUES)
        found = []
        for i, j in zip(at[:-1], at[1:]):
            m, sig, own = j - i, sigs[i:j], ids[i:j]
            if m < 2:
                continue
            order = np.lexsort(np.roll(sig, -int(tree[i]) * DEPTH, axis=1).T[::-1])
            a, b = order[:-1], order[1:]
            e = (sig[a] == sig[b]).mean(axis=1, dtype=np.float32)
            if m > 4:
                spread = order[np.unique(np.linspace(0, m - 1, SPREAD).astype(int))]
                mean = np.concatenate([estimates(sig[k : k + 4096], sig[spread]).mean(axis=1) for k in range(0, m, 4096)])
                centre = np.lexsort((own, -mean))[:CENTRES]
                est = np.concatenate([estimates(sig[k : k + 4096], sig[centre]) for k in range(0, m, 4096)])
                est[centre, np.arange(len(centre))] = 0
                top = est.argmax(axis=1)
                a, b, e = np.append(a, np.arange(m)), np.append(b, centre[top]), np.append(e, est[np.arange(m), top])
            a, b = own[a], own[b]
            ok = (a != b) & (e >= LEAST_ESTIMATE)
            found.append((np.minimum(a, b)[ok], np.maximum(a, b)[ok], e[ok]))
        if found:
            yield _pair_rows(*(np.concatenate(c) for c in zip(*found)))


def _pair_rows(a, b, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.float64())], names=["a", "b", "e"])


def _open_pairs(skip: int, take: int):
    """Of regions, rows (key, tree, id, n, wide, places, component, side): for every node
    outside the region's largest component, its partners number skip..skip+take by
    estimated similarity, as far as they are in other components. A pair counts only
    in the first tree whose region it shares (places: a node's region in every tree).
    Of a pair of blocks, rows of side 1 are the open nodes and of side 2 the partners;
    whole regions have side 0. (null, null) says that partners beyond remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in whole_groups(batches):
            tree, all_ids, all_n, all_comp, all_side = (whole.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 6, 7))
            all_wide = text_buffers(whole.column(4))[0].reshape(-1, WIDE)
            all_places = whole.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, TREES)
            found, more = [], False
            for i, j in zip(at[:-1], at[1:]):
                ids, n, wide, places, comp, t = all_ids[i:j], all_n[i:j], all_wide[i:j], all_places[i:j], all_comp[i:j], int(tree[i])
                names, which, size = np.unique(comp, return_inverse=True, return_counts=True)
                if len(names) < 2:
                    continue
                side = all_side[i:j]
                small = np.flatnonzero(side == 1 if side.any() else which != size.argmax())
                other = np.flatnonzero(side != 1)
                if not len(small) or not len(other):
                    continue
                ow, on = wide[other, :VALUES], n[other]
                block = max(1, 1_000_000 // len(other))
                for k in range(0, len(small), block):
                    rows = small[k : k + block]
                    near = (estimates(wide[rows, :VALUES], ow) >= LEAST_ESTIMATE) & _near_sizes(n[rows, None], on[None, :])
                    r, c = np.nonzero(near)
                    x, c = rows[r], other[c]
                    fresh = (ids[x] != ids[c]) & ~((places[x, :t] == places[c, :t]) & (places[x, :t] != 0)).any(axis=1)
                    r, c = r[fresh], c[fresh]
                    e = np.concatenate([np.zeros(0), *((wide[rows[r[z : z + 20_000]]] == wide[c[z : z + 20_000]]).mean(axis=1) for z in range(0, len(r), 20_000))])
                    ok = e >= LEAST_WIDE
                    r, c, e = r[ok], c[ok], e[ok]
                    order = np.lexsort((ids[c], -e, r))
                    r, c, e = r[order], c[order], e[order]
                    rank, x = np.arange(len(r)) - np.searchsorted(r, r), rows[r]
                    apart = comp[c] != comp[x]
                    more |= bool((apart & (rank >= skip + take)).any())
                    pick = apart & (rank >= skip) & (rank < skip + take)
                    a, b = ids[x[pick]], ids[c[pick]]
                    found.append((np.minimum(a, b), np.maximum(a, b), e[pick]))
            if found:
                yield _pair_rows(*(np.concatenate(c) for c in zip(*found)))
            if more:
                yield _pair_rows([None], [None], [None])

    return run


def regions(nodes: DataFrame, tables: Tables, region_rows: int = REGION_ROWS) -> tuple[DataFrame, DataFrame, bool]:
    """Rows of every region with two nodes or more: (key, tree, id, c), c its nodes, and
    (key, tree, id) of parts of at most about ``region_rows`` nodes, by adaptive depth.
    The last says whether there are larger regions than that."""
    depth, done, area, large = DEPTH, None, None, False
    ids = nodes.select("id", F.posexplode("keys").alias("tree", "key")).select("key", "tree", "id")
    while True:
        counts = ids.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("head")).where("c > 1")
        kept = tables.put(ids.join(counts, "key"))
        area = kept.select("key", "tree", "id", "c") if area is None else area
        fits = kept.where(F.col("c") <= region_rows).select("key", "tree", "id")
        done = fits if done is None else done.unionByName(fits)
        big = kept.where(F.col("c") > region_rows)
        if not big.limit(1).count():
            break
        large = True
        # deeper by four more values of the tree's order; at the end of the signature, by id
        big = big.join(nodes.select("id", "sig"), "id")
        at = F.pmod(F.col("tree") * DEPTH + depth, F.lit(VALUES)) + 1
        more = F.substring(F.concat("sig", "sig"), at.cast("int"), F.lit(4)) if depth + 4 <= VALUES else F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / region_rows) * 2).cast("string").cast("binary")
        big = big.withColumn("old", F.col("key")).withColumn("key", F.xxhash64("old", more))
        heads = big.select("key", "tree", F.col("head").alias("id")).distinct()
        ids = tables.put(big.select("key", "tree", "id").unionByName(heads).distinct())
        depth += 4
    return area, done, large


def _blocks(named: DataFrame, region_rows: int) -> DataFrame:
    """Of rows (key, tree, id, c, component) of large regions: blocks of the nodes outside
    the region's largest component with blocks of all nodes, each pair of blocks a key."""
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.first("c").alias("c"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.first("c").alias("c")).where("most.n < c")
    most = most.select("key", F.col("most.component").alias("largest"), F.ceil((F.col("c") - F.col("most.n")) / region_rows).alias("ps"), F.ceil(F.col("c") / region_rows).alias("qs"))
    rows, deal = named.join(most, "key"), lambda seed, parts: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    small = rows.where(F.col("component") != F.col("largest")).withColumn("p", deal(1, "ps")).withColumn("q", every("qs")).withColumn("side", F.lit(1))
    other = rows.withColumn("q", deal(2, "qs")).withColumn("p", every("ps")).withColumn("side", F.lit(2))
    return small.unionByName(other).select(F.xxhash64("key", "p", "q").alias("key"), "tree", "id", "component", "side")


def near_links(nodes: DataFrame, texts_of, similarity: int = SIMILARITY, region_rows: int = REGION_ROWS) -> DataFrame:
    """(id, component) over ``nodes`` (id, n, keys, sig); ``texts_of`` gives the rows
    (id, text) of a table of ids."""
    tables = Tables(nodes.sparkSession, "near-links")
    area, parts, large = regions(nodes, tables, region_rows)
    sets = tables.put(texts_of(area.select("id").distinct()).select("id", "text").mapInArrow(_set_rows, "id long, s binary, wide binary"))

    def check(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
        return tables.put(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_checked(similarity), "a long, b long, linked boolean"))

    def still_open(pairs: DataFrame, comp: DataFrame, tested: DataFrame) -> DataFrame:
        ca, cb = (comp.select(F.col("id").alias(c), F.col("component").alias("c" + c)) for c in "ab")
        pairs = pairs.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        return pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")

    def by_region(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "id")

    near = by_region(parts.join(nodes.select("id", "sig"), "id").select("key", "tree", "id", "sig"))
    near = tables.put(near.mapInArrow(_neighbour_pairs, "a long, b long, e double").groupBy("a", "b").agg(F.max("e").alias("e")))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
    best = both.groupBy("a").agg(F.max_by("b", "e").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = check(best)
    comp = components(tested.where("linked"))
    last = check(still_open(near, comp, tested))
    tested = tested.unionByName(last)
    if last.where("linked").limit(1).count():
        comp = components(tested.where("linked"))
    tables.drop(near)
    wide = tables.put(nodes.select("id", "n", F.col("keys").alias("places")).join(sets.select("id", "wide"), "id"))
    # the second round starts over, as another component may be the largest by then
    take = 32
    while True:
        named = area.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        small = named.where(F.col("c") <= region_rows)
        split = small.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        rows = small.join(split, "key", "left_semi").select("key", "tree", "id", "component", F.lit(0).alias("side"))
        if large:
            rows = rows.unionByName(_blocks(named.where(F.col("c") > region_rows), region_rows))
        rows = rows.join(wide, "id").select("key", "tree", "id", "n", "wide", "places", "component", "side")
        found = tables.put(by_region(rows).mapInArrow(_open_pairs(0, take), "a long, b long, e double"))
        last = check(still_open(found.where("a IS NOT NULL"), comp, tested))
        if last.where("linked").limit(1).count():
            tested = tested.unionByName(last)
            comp = components(tested.where("linked"))
        more = found.where("a IS NULL").limit(1).count()
        tables.drop(found)
        if not more:
            delete(nodes.sparkSession, [tables.path])
            return comp
        take = 1 << 40


def _marked(docs: DataFrame, text: str, doc_id: str, similarity: int, region_rows: int) -> DataFrame:
    """(doc_id, text_id, n_shingles, component_id, kept), text_id the hash of the text."""
    tables = Tables(docs.sparkSession, "near-dedup")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("text_id", F.xxhash64("text"))
    base = tables.put(rows.mapInArrow(_signed, "doc_id long, n_shingles long, set_id binary, keys array<long>, sig binary, text_id long"))
    some = base.where("set_id IS NOT NULL")
    # the row that lends its text to a set: the smallest id's, and of its texts the smallest hash
    lender = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id", F.col("n_shingles").alias("n"), "keys", "sig")
    first = some.groupBy("set_id").agg(F.min(lender).alias("x"))
    nodes = tables.put(first.select("set_id", F.monotonically_increasing_id().alias("id"), "x.doc_id", "x.text_id", "x.n", "x.keys", "x.sig"))
    again = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()

    def texts_of(ids: DataFrame) -> DataFrame:
        lenders = nodes.join(ids, "id").select("id", F.col("doc_id").alias("d"), F.col("text_id").alias("t"))
        lent = rows.join(lenders, rows.doc_id.eqNullSafe(F.col("d")) & (rows.text_id == F.col("t"))).select("id", "text")
        return lent.dropDuplicates(["id"]) if again else lent  # rows that repeat id and text

    comp = near_links(nodes, texts_of, similarity, region_rows)
    named = nodes.select("id", "set_id", "doc_id").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "component").select(F.col("set_id").alias("__set"), "least")
    out = base.select("doc_id", "text_id", "n_shingles", "set_id").join(named, F.col("set_id") == F.col("__set"), "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "text_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: int = SIMILARITY, region_rows: int = REGION_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``.

    Documents link at 100 * intersection >= ``similarity`` * union of their sets;
    component_id is the smallest id reachable. Null texts and texts without words
    have the empty set, link with nothing and stay. A text of fewer than five
    words is one shingle. A set is a node of its own, whatever its rows' ids: rows that
    repeat an id with different texts are different nodes, and rows with a null id link
    like others. A null id ranks last; a component of such rows alone has a null id and
    its rows are kept, as no id tells them apart. An empty table gives an empty result."""
    return _marked(docs, text, doc_id, similarity, region_rows).drop("text_id")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that near_dedup keeps, with the columns of ``docs``."""
    kept = _marked(docs, text, doc_id, SIMILARITY, REGION_ROWS).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text")).distinct()
    whole = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.join(kept, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (whole == F.col("__text")), "left_semi").select(*docs.columns)
