"""Plain versions of the operators' results, on lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def exact(docs):
    groups = defaultdict(list)
    shas = {}
    for place, (i, text) in enumerate(docs):
        body = b" ".join((b"\0" + (text or "").encode() + b"\0").split())  # keeps one space at either end
        sha = hashlib.sha256(body[1:-1]).hexdigest()
        shas[place] = sha
        groups[sha].append(i)
    return sorted((i, min(groups[shas[p]]), len(groups[shas[p]]), shas[p]) for p, (i, _) in enumerate(docs))


def shingles(text, size):
    w = words(text, lower=True)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def near(docs, size):
    """Smallest id of each document's component, by comparing all pairs; ids are distinct."""
    sets = {i: shingles(t, size) for i, t in docs}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(docs, window=50):
    """For each document (id, bytes, removed bytes, spans, remaining bytes), in the order given."""
    first = {}
    for i, text in docs:
        data = (text or "").encode()
        for p in range(len(data) - window + 1):
            key = data[p : p + window]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            if first[data[p : p + window]] < i:
                gone[p : p + window] = b"\1" * window
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), spans, kept))
    return out
