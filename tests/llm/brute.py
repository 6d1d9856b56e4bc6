"""Plain versions of the operators, for small tables."""

import re
import string

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def shingles(text, n):
    found = words(lower(text))
    return {tuple(found[i:i + n]) for i in range(len(found) - n + 1)} or ({tuple(found)} if found else set())


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near(rows, n, percent):
    """{id: (size, component)} of (id, text)."""
    sets = {i: shingles(t, n) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[:k]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    group = components(ids, links)
    return {i: (len(sets[i]), group[i]) for i in ids}


def without_repeats(rows, window):
    """{id: kept words} of (id, text)."""
    first, out = {}, {}
    for i, text in sorted(rows):
        found = words(text)
        for k in range(len(found) - window + 1):
            first.setdefault(tuple(found[k:k + window]), (i, k))
    for i, text in rows:
        found = words(text)
        keep = [True] * len(found)
        for k in range(len(found) - window + 1):
            if first[tuple(found[k:k + window])] < (i, k):
                keep[k:k + window] = [False] * window
        out[i] = [w for w, x in zip(found, keep) if x]
    return out


def contained(docs, items, n, share):
    """{(doc, item): shared} of (id, text) rows."""
    def cut(text):
        found = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        return {tuple(found[i:i + n]) for i in range(len(found) - n + 1)}

    sets = [(i, cut(t)) for i, t in items]
    return {
        (d, i): len(s & held) for d, t in docs for held in [cut(t)] for i, s in sets if s and len(s & held) >= share * len(s) - 1e-9
    }


def links(vectors, threshold):
    """{id: (links, component)} of (id, list)."""
    import numpy as np

    unit = {}
    for i, v in vectors:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(v)
    found = [(a, b) for a in unit for b in unit if a > b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    count = {i: 0 for i, _ in vectors}
    for a, b in found:
        count[a] += 1
        count[b] += 1
    group = components([i for i, _ in vectors], found)
    return {i: (count[i], group[i]) for i, _ in vectors}
