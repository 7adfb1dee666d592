"""The operators' contracts, computed the plain way."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(rows, units, length):
    """Of (doc_id, sequence) rows: for each, which places lie in a window that a smaller id has."""
    first = {}
    for doc, text in rows:
        if doc is not None:
            u = units(text)
            for i in range(len(u) - length + 1):
                k = tuple(u[i : i + length])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        u = units(text)
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if doc is not None and first[tuple(u[i : i + length])] < doc:
                gone[i : i + length] = [True] * length
        out.append((doc, u, gone))
    return out


def op1(rows, length=50):
    out = []
    for doc, u, gone in repeats(rows, lambda t: (t or "").encode(), length):
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(u), sum(gone), spans, sha(bytes(b for b, g in zip(u, gone) if not g))))
    return out


def op4(rows, window=50):
    out = []
    for doc, u, gone in repeats(rows, lambda t: WORD.findall(t or ""), window):
        out.append((doc, len(u), sum(gone), sha(" ".join(w for w, g in zip(u, gone) if not g).encode())))
    return out


def shingles(text, n):
    w = WORD.findall((text or "").translate(AZ))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def op5(rows, n=4, percent=80):
    sets = [(doc, shingles(text, n)) for doc, text in rows]
    parent = {doc: doc for doc, _ in sets if doc is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = sorted((find(a), find(b)))
                parent[s] = r
    return [(doc, len(x), None if doc is None else find(doc), doc is None or find(doc) == doc) for doc, x in sets]


def op6(rows):
    out = []
    for doc, text in rows:
        text = text or ""
        w = WORD.findall(text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(windows)
        again = {j for i, k in enumerate(windows) if n[k] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)))
    return out


def op8(rows, items, n=10):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: cut.findall((t or "").translate(AZ))
    grams = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if w else ():
            grams.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    found |= grams[tuple(w[i : i + k])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), sha(",".join(names).encode()), bool(hit)))
    return out
