"""Plain Python versions of the operators, for small inputs."""

import hashlib
from collections import Counter


def words(text):
    return (text or "").encode().split()


def substrings(rows, length=50):
    """[(doc_id, text)] -> [(doc_id, n_words, n_removed, sha256)]."""
    first = {}
    for i, t in rows:
        w = words(t)
        for x in range(len(w) - length + 1):
            if i is not None:
                k = tuple(w[x:x + length])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for x in range(len(w) - length + 1):
            if i is not None and first[tuple(w[x:x + length])] < i:
                gone[x:x + length] = [True] * length
        kept = b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))}


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def near_duplicates(rows):
    """[(doc_id, text)] -> {doc_id: component} over ids that are not null."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n]
             if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return components({i for i, _ in sets}, links)


def repeat_words(text):
    w = words(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(covered)
