"""Slow, obvious versions of the operators that tests hold results against."""

import collections
import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_set(text, n=3):
    w = SPACED.findall((text or "").translate(LOWER))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def jaccard_components(rows, n=3, percent=90):
    sets = [(i, shingle_set(t, n)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            o = len(a & b)
            if a and b and 100 * o >= percent * (len(a) + len(b) - o):
                p, q = sorted((find(i), find(j)))
                label[q] = p
    return [(i, len(s), find(i)) for i, s in sets]


def first_copies_removed(rows, size=20):
    """(id, words, removed, digest) when only the first start of each window stays."""
    words = [(i, SPACED.findall(t or "")) for i, t in sorted(rows)]
    seen, out = set(), []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone[s : s + size] = [True] * size
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contaminated(rows, items, span=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        if i is None or not w:
            continue
        m = min(span, len(w))
        for s in range(len(w) - m + 1):
            windows[tuple(w[s : s + m])].add(i)
    out = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    found |= windows[tuple(w[s : s + m])]
                    hit[s : s + m] = [True] * m
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), any(hit)))
    return out
