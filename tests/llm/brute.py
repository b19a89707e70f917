"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def repeats(docs, length=50):
    """{id: (n_bytes, n_removed, n_spans, sha256 of the rest)}"""
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        windows = [b[k : k + length] for k in range(len(b) - length + 1)]
        gone = [False] * len(b)
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + length] = [True] * length
        seen.update(windows)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])


def near_duplicates(docs, k, num, den):
    """{id: (n_shingles, component)}"""
    sets = {i: shingles(t, k) for i, t in docs}
    by = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    links = set()
    for i, s in sets.items():
        for j in set().union(*(by[g] for g in s)) if s else ():
            if j > i:
                common = len(s & sets[j])
                if common * den >= (len(s) + len(sets[j]) - common) * num:
                    links.add((i, j))
    comp = components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}
