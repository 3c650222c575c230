"""Plain versions of the operators for small inputs."""

import re
from itertools import combinations


def word_list(text):
    text = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    return re.findall("[^\x20\x09-\x0d]+", text)


def shingle_set(text, k=5):
    w = word_list(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def component_of(rows, percent=75):
    """{doc_id: smallest doc_id reachable}."""
    sets = {}
    for d, t in rows:
        sets.setdefault(frozenset(shingle_set(t)), []).append(d)
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(x, y):
        x, y = sorted((find(x), find(y)))
        up[y] = x

    for s, ds in sets.items():
        for d in ds:
            if s:
                join(ds[0], d)
    by = {}
    keys = [s for s in sets if s]
    for i, s in enumerate(keys):
        for g in s:
            by.setdefault(g, []).append(i)
    seen = set()
    for owners in by.values():
        for i, j in combinations(owners, 2):
            if (i, j) not in seen:
                seen.add((i, j))
                a, b = keys[i], keys[j]
                if 100 * len(a & b) >= percent * len(a | b):
                    join(sets[a][0], sets[b][0])
    return {d: find(d) for d in up}
