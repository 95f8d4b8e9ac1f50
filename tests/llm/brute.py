"""Plain Python versions of what the operators compute, for small tables."""

import collections
import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^ \t-\r]+")
BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def components(keys, links):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def similar(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    ids = sorted(sets)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return {k: len(s) for k, s in sets.items()}, components(ids, links)


def passages(texts, bench):
    windows = collections.defaultdict(set)
    for item, text in bench:
        w = BENCH_WORD.findall((text or "").translate(FOLD))
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add(item)
    sizes, out = {len(k) for k in windows}, {}
    for key, text in texts.items():
        w = BENCH_WORD.findall((text or "").translate(FOLD))
        hit, items = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if found := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    items |= found
        out[key] = (len(w), len(hit), sorted(str(x) for x in items if x is not None))
    return out
