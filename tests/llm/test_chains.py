"""Parts that many sets have chain no families together, and similar sets still agree in one that stays."""

import numpy as np
import pytest

from lantern.llm import jaccard


def some(r, n):
    return np.sort(r.integers(0, 2**63, n, dtype=np.uint64))


def told(parts, sets):
    """All parts of these sets as frequent ones, with how many sets have each."""
    h, times = np.unique(np.concatenate([parts.signatures([s], np.array([1]))[0] for s in sets]), return_counts=True)
    return h, times


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_agree_whatever_the_counts(percent):
    r = np.random.default_rng(2)
    parts = jaccard.Parts(jaccard.Fraction(percent, 100))
    for n in [*range(1, 60), 100, 333, 2000]:
        for _ in range(10 if n < 1000 else 2):
            a = some(r, n)
            b = np.delete(a, r.choice(n, n * (100 - percent) // 100, replace=False))
            h, times = told(parts, [a, b])
            frequent = h, r.integers(1, 50, len(h)) * r.integers(0, 2, len(h))
            x, y = (set(parts.signatures([s], np.array([1]), frequent)[0].tolist()) for s in (a, b))
            assert len(a) == len(b) or x & y


def test_a_common_passage_makes_no_chain():
    """A fifth of each set is the same in all: without the counts they all share a signature, with them no two do."""
    r = np.random.default_rng(3)
    parts = jaccard.Parts(jaccard.Fraction(80, 100))
    common = some(r, 20)
    sets = [np.sort(np.concatenate([common, some(r, 80)])) for _ in range(30)]
    plain = [set(parts.signatures([s], np.array([1]))[0].tolist()) for s in sets]
    assert any(a & b for i, a in enumerate(plain) for b in plain[:i])
    kept = [set(parts.signatures([s], np.array([1]), told(parts, sets))[0].tolist()) for s in sets]
    assert not any(a & b for i, a in enumerate(kept) for b in kept[:i])
