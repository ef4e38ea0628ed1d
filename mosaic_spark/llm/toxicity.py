"""Toxicity by a classifier chain.

Labelled rows say only toxic or not, so the categories are found in them: toxic
training documents are clustered by the terms that set them apart. The chain
predicts category after category and last the label itself; each linear model also
sees the probabilities of the categories before it. Those are out-of-fold in
training, so no model learns from probabilities that saw its own rows.

Terms are whole words and word beginnings of 4 to 6 letters, as presence. Training
is on a bounded sample of labelled rows (``most_toxic``, ``most_clean``: parameters);
scoring reads every whole text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES, FOLDS, TERMS = 3, 4, 3000
MOST_TOXIC, MOST_CLEAN = 1200, 2400
LEAST_DOCS = 4
_WORD = re.compile(r"[^\W\d_]+")
_HEADS = (4, 5, 6)


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms_of(text: str) -> set[str]:
    words = words_of(text)
    out = set(words)
    for k in _HEADS:
        out |= {w[:k] + "~" for w in words if len(w) >= k}
    return out


@dataclass
class Chain:
    """terms -> column; weights[c] has a weight per term, then one per earlier
    category probability, then a bias."""

    terms: dict[str, int]
    weights: list[np.ndarray]
    threshold: float = 0.5

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, a row per text: the categories, then toxic."""
        get, rows, cols = self.terms.get, [], []
        for i, t in enumerate(texts):
            found = []
            for w in words_of(t) if t else ():
                found.append(get(w))
                n = len(w)
                if n >= 4:
                    found.append(get(w[:4] + "~"))
                    if n >= 5:
                        found.append(get(w[:5] + "~"))
                        if n >= 6:
                            found.append(get(w[:6] + "~"))
            found = {c for c in found if c is not None}
            cols += found
            rows += [i] * len(found)
        return _chained(np.array(rows, np.int64), np.array(cols, np.int64), len(texts), len(self.terms), self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _chained(rows, cols, n, m, weights) -> np.ndarray:
    p = np.zeros((n, len(weights)))
    for c, w in enumerate(weights):
        z = np.bincount(rows, w[cols], n) if len(rows) else np.zeros(n)
        p[:, c] = _sigmoid(z + p[:, :c] @ w[m : m + c] + w[-1])
    return p


def _logistic(rows, cols, n, m, extra, y, l2=1.0, steps=80) -> np.ndarray:
    """L2 logistic regression by accelerated gradient steps; ``extra`` are dense columns."""
    k = extra.shape[1]
    w = np.zeros(m + k + 1)
    v = w.copy()
    per_row = np.bincount(rows, minlength=n).max() + k + 1 if len(rows) else k + 1
    rate = 1 / (0.25 * per_row * max(1.0, np.sqrt(n)) / 4 + l2)
    for t in range(steps):
        z = np.bincount(rows, v[cols], n) + extra @ v[m : m + k] + v[-1]
        r = _sigmoid(z) - y
        g = np.concatenate([np.bincount(cols, r[rows], m), extra.T @ r, [r.sum()]])
        g[:-1] += l2 * v[:-1]
        new = v - rate * g
        v, w = new + t / (t + 3) * (new - w), new
    return w


def _clusters(rows, cols, n, m, members, k) -> np.ndarray:
    """Category of each member document by spherical k-means over its terms; seeds
    are taken far apart, so the result does not depend on chance."""
    x = np.zeros((len(members), m), np.float32)
    place = np.full(n, -1)
    place[members] = np.arange(len(members))
    ok = place[rows] >= 0
    x[place[rows[ok]], cols[ok]] = 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[int(x.sum(axis=1).argmax())]]
    for _ in range(k - 1):
        centres.append(x[int((x @ np.array(centres).T).max(axis=1).argmin())])
    centres = np.array(centres)
    for _ in range(15):
        at = (x @ centres.T).argmax(axis=1)
        for c in range(k):
            if (at == c).any():
                mean = x[at == c].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-9)
    return at


def fit_chain(texts: list[str], toxic: list[int], categories: int = CATEGORIES, seed: int = 5) -> Chain:
    """A chain from labelled texts; without both labels it calls nothing toxic."""
    y = np.asarray(toxic, float)
    n = len(texts)
    if n == 0 or y.min() == y.max():
        return Chain({}, [np.array([0.0] * c + [-35.0]) for c in range(categories + 1)])
    # a term is a number from here on: sets of strings took 300 MB of the driver at 3,600 documents
    number: dict[str, int] = {}
    found = [np.array([number.setdefault(term, len(number)) for term in terms_of(t)], np.int32) for t in texts]
    in_toxic, in_clean = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    for f, t in zip(found, toxic):
        (in_toxic if t else in_clean)[f] += 1
    a, b = y.sum(), n - y.sum()
    r = (in_toxic + in_clean) / n
    z = (in_toxic / a - in_clean / b) / np.sqrt(np.maximum(r * (1 - r) * (1 / a + 1 / b), 1e-12))
    often = [(term, i) for term, i in number.items() if in_toxic[i] + in_clean[i] >= LEAST_DOCS]
    del number
    best = sorted(often, key=lambda x: (-abs(z[x[1]]), x[0]))[:TERMS]
    terms = {term: c for c, (term, _) in enumerate(best)}
    m = len(terms)
    taken = np.array([i for _, i in best], np.int64)
    column = np.full(len(z), -1)
    column[taken] = np.arange(m)
    found = [np.sort(column[f]) for f in found]  # not in the order of the sets, which differs from run to run
    found = [f[f >= 0] for f in found]
    rows = np.repeat(np.arange(n), [len(f) for f in found])
    cols = np.concatenate(found)
    cues = z[taken] > 0
    members = np.flatnonzero(y == 1)
    telling = cues[cols]
    at = _clusters(rows[telling], cols[telling], n, m, members, min(categories, len(members)))
    labels = np.zeros((n, categories + 1))
    labels[members, at] = 1
    labels[:, -1] = y
    fold = np.random.default_rng(seed).permutation(n) % FOLDS
    earlier, weights = np.zeros((n, 0)), []
    for c in range(categories + 1):
        out = np.zeros(n)
        for k in range(FOLDS):
            train = fold != k
            new = np.cumsum(train) - 1
            ok = train[rows]
            w = _logistic(new[rows[ok]], cols[ok], int(train.sum()), m, earlier[train], labels[train, c])
            z_all = np.bincount(rows, w[cols], n) + earlier @ w[m : m + c] + w[-1]
            out[~train] = _sigmoid(z_all[~train])
        weights.append(_logistic(rows, cols, n, m, earlier, labels[:, c]))
        earlier = np.column_stack([earlier, out])
    # the threshold with the fewest out-of-fold errors, the middle of ties; a wrong alarm counts as a miss
    p = earlier[:, -1]
    grid = np.linspace(0.05, 0.95, 91)
    errors = np.array([((p >= t) != (y == 1)).sum() for t in grid])
    return Chain(terms, weights, float(np.median(grid[errors == errors.min()])))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Chain:
    """Fits on at most ``most_toxic`` + ``most_clean`` labelled rows of ``docs``, the
    first in hash order, so the sample is the same in every run. Labels that repeat an
    id count once, as toxic if one of them says so."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    known = known.groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    order = F.xxhash64("__id", F.lit("toxic"))
    picks = [known.where(F.col("__toxic") == v).orderBy(order, "__id").limit(k) for v, k in ((1, most_toxic), (0, most_clean))]
    sample = picks[0].unionByName(picks[1])
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(sample), "__id")  # bounded by the two limits

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [" ".join(sorted(words_of(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.string()), b.column(2)], names=["id", "bag", "toxic"])

    got = rows.select("__id", "__text", "__toxic").mapInArrow(learn, "id long, bag string, toxic int").collect()
    got.sort(key=lambda r: (r.id, r.toxic, r.bag))
    return fit_chain([r.bag for r in got], [r.toxic for r in got])


def score(docs: DataFrame, chain: Chain, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` columns are not carried: (doc_id, p_category_1.., toxicity, toxic,
    kept), a row per row. Null and empty texts are not toxic."""
    names = [*(f"p_category_{c + 1}" for c in range(len(chain.weights) - 1)), "toxicity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.slice(i, 2000)
                texts = part.column(1).to_pylist()
                p = np.round(chain.score(texts), 6)
                bad = (p[:, -1] >= chain.threshold) & np.array([bool(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in p.T], pa.array(bad), pa.array(~bad)], names=["doc_id", *names, "toxic", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} double" for c in names) + ", toxic boolean, kept boolean"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on the labelled rows and scores every row of ``docs``."""
    return score(docs, train(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not toxic, with the columns of ``docs``. The mark is
    computed beside each row, so repeated ids and null ids need no join."""
    chain = train(docs, labels, text)
    fields = docs.schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                texts = part.column(at).to_pylist()
                p = np.round(chain.score(texts)[:, -1], 6)
                yield part.filter(pa.array((p < chain.threshold) | np.array([not t for t in texts], bool)))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, fields)
