"""Plain versions of the operators, for small inputs."""

import base64
import hashlib
import re
from itertools import combinations

BLANK_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NORMAL_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def decontaminate(docs, items, window=10):
    sets = []
    for i, t in items:
        w = NORMAL_WORD.findall(lower(t or ""))
        sets.append((str(i), {tuple(w[j : j + window]) for j in range(max(1, len(w) - window + 1))} if w else set()))
    lengths = {len(x) for _, s in sets for x in s}
    out = {}
    for d, t in docs:
        w = NORMAL_WORD.findall(lower(t or ""))
        hit, found = set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                x = tuple(w[j : j + n])
                for i, s in sets:
                    if x in s:
                        hit.update(range(j, j + n))
                        found.add(i)
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit))
    return out


def suffixes(docs, n=50):
    first = {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        for j in range(len(b) - n + 1):
            first.setdefault(b[j : j + n], d)
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if first[b[j : j + n]] < d:
                cut[j : j + n] = b"\1" * n
        runs = sum(1 for i in range(len(b)) if cut[i] and (not i or not cut[i - 1]))
        out[d] = (len(b), sum(cut), runs, sha(bytes(x for x, c in zip(b, cut) if not c)))
    return out


def substrings(docs, n=20):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = BLANK_WORD.findall((t or "").encode())
        cut = [False] * len(w)
        for j in range(len(w) - n + 1):
            x = tuple(w[j : j + n])
            if x in seen:
                cut[j : j + n] = [True] * n
            seen.add(x)
        out[d] = (len(w), sum(cut), sha(b" ".join(x for x, c in zip(w, cut) if not c)))
    return out


def shingles(t, n):
    w = BLANK_WORD.findall((t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    return {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()


def near(docs, n=4, num=80):
    sets = {d: shingles(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    post = {}
    for d, s in sets.items():
        for x in s:
            post.setdefault(x, []).append(d)
    pairs = {p for m in post.values() if len(m) > 1 for p in combinations(sorted(m), 2)}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= num * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def base32_sha1(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def warc(pages):
    first, out = {}, {}
    for p, _, h in sorted(pages, key=lambda x: x[0]):
        b = (h or "").encode()
        k = first.setdefault(b, p)
        out[p] = (len(b), base32_sha1(b), "response" if k == p else "revisit", None if k == p else k)
    return out


def topk(vectors, k=5):
    import math

    rows = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    scores = {}
    for q, x in rows:
        if q % 50 == 0:  # zip: a shorter vector counts as padded with zeros
            scores.setdefault(q, []).extend((-sum(a * b for a, b in zip(x, v)), i) for i, v in rows if i != q)
    return {(q, r): (i, -x) for q, s in scores.items() for r, (x, i) in enumerate(sorted(s)[:k], 1)}
