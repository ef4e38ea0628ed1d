"""Small corpora with copies, near copies, shared passages and odd rows."""

import random


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randint(1, 200))) for _ in range(n // 3)]
    passage = " ".join(words(rng, 70))
    docs = []
    for i in range(n):
        t = rng.choice(base)
        kind = i % 6
        if kind == 1:
            t = "  " + t.replace(" ", "\n", 3) + "\t"
        elif kind == 2:
            w = t.split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = " ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 20))
        elif kind == 4:
            t = " ".join(words(rng, rng.randint(1, 120)))
        docs.append((i, t))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "ééß " * 200), (n + 6, "x" * 5000), (n + 7, "ab" * 300)]
    return docs


SCHEMA = "doc_id long, text string"
