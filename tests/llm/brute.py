"""Plain versions of operators, for comparison on small tables."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, k):
    w = WORD.findall(fold(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def classes(rows, k, num, den):
    """rows: (doc_id, text); returns (doc_id, n_shingles, component_id), sorted."""
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
            up[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), (least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str)
