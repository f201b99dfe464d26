"""Plain restatements of the contracts, to hold the operators against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(b: bytes | str) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def shingles(text: str | None) -> frozenset:
    w = SPACED.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in rows}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring(rows: list[tuple[int, str | None]], n: int = 13) -> dict[int, tuple[int, int, str]]:
    words = {i: SPACED.findall(t or "") for i, t in rows}
    first: dict = {}
    for i in sorted(words):
        for s in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][s : s + n]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < i:
                gone[s : s + n] = [True] * n
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def suffixes(rows: list[tuple[int, str | None]], n: int = 200) -> dict[int, tuple[int, int, int, str]]:
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(b[s : s + n]) for _, b in texts for s in range(len(b) - n + 1))
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if seen[hash(b[s : s + n])] > 1:
                gone[s : s + n] = b"\1" * n
        spans = sum(1 for s in range(len(b)) if gone[s] and (s == 0 or not gone[s - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def contamination(rows: list[tuple[int, str | None]], items: list[tuple[int, str | None]], n: int = 13) -> dict[int, tuple]:
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        k = min(n, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s : s + k])].add(str(i))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for i, t in rows:
        w = ALNUM.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (x := windows.get(tuple(w[s : s + k]))) is not None:
                    hit[s : s + k] = [True] * k
                    found |= x
        out[i] = (len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out
