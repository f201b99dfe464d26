"""What the operators' work in Python may cost: one call for many groups or texts, not one for each."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lantern.llm import pieces, queries, suffixes


def contexts(r: random.Random, groups: int, members: int) -> list[tuple[int, bytes, bytes]]:
    """Rows (anchor, suffix, before) in suffix order: the members of an anchor share strings of all lengths with others of it."""
    rows = []
    for g in range(groups):
        gram, after, ahead = (bytes(r.choice(b"abcd") for _ in range(k)) for k in (50, 150, 150))
        for _ in range(r.randint(3, members)):
            a, b = r.randint(0, 150), r.randint(0, 150)
            noise = lambda k: bytes(r.choice(b"xyz") for _ in range(k))
            rows.append((g, (gram + after[:a] + noise(150 - a))[: r.choice((200, 200, 120))], (noise(150 - b) + ahead[150 - b :])[-r.choice((150, 150, 90)) :]))
    return sorted(rows)


def shared(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def brute(rows):
    """For each row, the bytes that it shares most to the left and to the right with a row of its anchor with which it shares 200."""
    out = {}
    for i, (g, suffix, before) in enumerate(rows):
        both = [(shared(before[::-1], q[::-1]), shared(suffix, p)) for j, (h, p, q) in enumerate(rows) if h == g and j != i]
        if both := [(x, y) for x, y in both if x + y >= 200]:
            out[i] = tuple(map(max, zip(*both, strict=True)))
    return out


def solved(rows, size):
    column = lambda k, kind: pa.array([x[k] for x in rows], kind)
    ids = pa.array(range(len(rows)), pa.int64())
    t = pa.table({"anchor": column(0, pa.int64()), "key": ids, "at": ids.cast(pa.int32()), "suffix": column(1, pa.binary()), "before": column(2, pa.binary())})
    got = [x for b in suffixes._groups(200, 50)(iter(t.combine_chunks().to_batches(max_chunksize=size))) for x in b.to_pylist()]
    return {x["key"]: (x["left"], x["right"]) for x in got}


def test_intervals_of_many_anchors_are_solved_at_once(monkeypatch):
    calls = []
    once = suffixes._Lowest.__call__
    monkeypatch.setattr(suffixes._Lowest, "__call__", lambda *a: calls.append(1) or once(*a))
    rows = contexts(random.Random(31), 12, 60)
    want = brute(rows)
    assert len(want) > 100
    assert solved(rows, 10_000) == want
    assert len(calls) <= 2  # it was one for each interval, and one more for each group that was found
    assert solved(rows, 25) == want


def test_intervals_are_solved_alike_in_slices(monkeypatch):
    rows = contexts(random.Random(32), 5, 40)
    monkeypatch.setattr(suffixes, "SLICE", 7)
    assert solved(rows, 10_000) == brute(rows)


def test_covered_reaches_as_far_as_the_maximal_repeats():
    r = np.random.default_rng(33)
    for _ in range(50):
        n = int(r.integers(3, 40))
        lcp, near, order = r.integers(50, 201, n - 1), r.integers(0, 151, n - 1), r.permutation(n)
        left, right = np.zeros((2, n), np.int64)
        for members, x, y in suffixes.maximal_repeats(np.arange(n), lcp, order, near, 200):
            left[members], right[members] = np.maximum(left[members], x), np.maximum(right[members], y)
        got = suffixes.covered(lcp, order, near, 200, 50)
        assert (got[0] == left).all() and (got[1] == right).all()


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(queries.tokenizer())


LETTERS = "etaoinshrdlu" * 4 + "ETAOéüß.,-'0123▁" + "日本語한😀́\t\u200b\x00~"


def test_agendas_of_many_parts_stand_side_by_side(model, monkeypatch):
    """Ordinary parts are merged together; only very long ones are merged alone."""
    alone = []
    once = pieces.Pieces.merge
    monkeypatch.setattr(pieces.Pieces, "merge", lambda self, part: alone.append(part) or once(self, part))
    r = random.Random(34)
    words = ["".join(r.choices(LETTERS.replace("▁", ""), k=r.randint(1, 30))) for _ in range(2000)]
    text = "".join(w + r.choice((" ", " ", " ", "\n")) for w in words)[:-1]
    model.forget()
    ids, n, decoded, differs = next(model.encode([text], check=False))
    theirs = model.library.encode(text)
    assert (ids, n, decoded, differs) == (",".join(map(str, theirs)), len(theirs), model.library.decode(theirs), False)
    assert not alone
    model.forget()
    assert not next(model.encode(["x" * 63 + " " + "x" * 64 + " a▁b  c"], check=False))[3]
    assert alone == ["▁" + "x" * 64]


@pytest.mark.parametrize("block", [70, 1 << 15])
def test_parts_merge_alike_alone_and_side_by_side(model, monkeypatch, block):
    monkeypatch.setattr(pieces, "BLOCK", block)
    r = random.Random(35)
    parts = ["".join(r.choices(LETTERS, k=r.randint(1, pieces.WIDE))) for _ in range(300)] + ["▁", "e" * 64, "▁" + "the" * 21, "\n", "\nabc"]
    found, begins, sizes = model.merge_many(parts)
    ends = np.cumsum(sizes)
    for p, lo, hi in zip(parts, (ends - sizes).tolist(), ends.tolist(), strict=True):
        at = [*begins[lo:hi].tolist(), len(p)]
        symbols = [p[a:b] for a, b in zip(at, at[1:], strict=False)]
        assert symbols == model.merge(p)
        assert all(k == model.id[s] for k, s in zip(found[lo:hi].tolist(), symbols, strict=True) if s in model.id)
    words = sorted({p for q in parts for p in pieces.Pieces.parts(q)} | {p.replace("▁", "").replace("\n", "") for p in parts})
    model.forget()
    model.differ = set()
    for p, v in model.learn(words).items():
        theirs = model.library.encode(p)[p[:1] == "\n" :]
        assert not p or (v if isinstance(v, str) else v[0]) == ",".join(map(str, theirs))
        if p[:1] != "\n":
            assert (" " + p if isinstance(v, str) else v[1])[1:] == model.library.decode(theirs)
    assert not model.differ


def test_a_part_that_the_library_encodes_otherwise_is_told(model, monkeypatch):
    """Among parts that are merged side by side, with and without symbols that are no pieces, just the one that differs."""

    class Other:
        def encode(self, x, num_threads=None):
            return [self.encode(y) for y in x] if isinstance(x, list) else [*theirs(x), 5] if x in ("house", "\ncafé", "日🜁") else theirs(x)

    theirs = model.library.encode
    monkeypatch.setattr(model, "library", Other())
    model.differ = set()
    model.learn(["the", "house", "日🜁", "🜁a", "\nthe"])
    assert model.differ == {"house", "日🜁"}
    model.learn(["the", "\ncafé", "\nthe"])
    assert model.differ == {"house", "日🜁", "\ncafé"}
