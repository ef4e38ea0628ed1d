"""Plain versions of the corpus operators' results, for small inputs."""

import hashlib
import itertools
import re

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in docs:
        norm = SPACE.sub("", t or "")
        keep = min(groups[norm])[1]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near(docs):
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return sorted((i, len(sets[i]), root[i], root[i] == i) for i in sets)


def suffixes(docs, depth=100):
    seen, out = set(), []
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            if w in seen:
                gone[p : p + depth] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def embeddings(vectors, cosine=0.95):
    ok = {}
    for i, v in vectors:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float)
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= cosine]
    root = roots([i for i, _ in vectors], links)
    n = {i: sum(i in x for x in links) for i, _ in vectors}
    return sorted((i, n[i], root[i], root[i] == i) for i, _ in vectors)
