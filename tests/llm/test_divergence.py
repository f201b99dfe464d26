"""The source divergence audit against plain restatements of its contract."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lantern.llm.divergence import divergence
from lantern.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, term string, n long, p long"


def brute(rows, least=3, top=200):
    """rows: (text, lang, source). Every term of a language against every pair of its sources."""
    texts, group, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        texts[lang].update(set(terms))
        group[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, n in texts[lang].items() if n >= least}

        def prices(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: prices(group[lang, s]) for s in sources}
        q = prices(sum((group[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if group[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(rows)], COLUMNS)
    got = [tuple(r) for r in divergence(df, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "ÉTÉ", "été", "日本", "ñandú", "ſ", "K"]
    rows = []
    for i in range(150):
        source = r.choice(["hot"] * 10 + [f"s{j}" for j in range(9)] + ["É", "é", None])
        own = words[:10] if source == "hot" else words
        rows.append((r.choice([" ", "1", "-", "\n"]).join(r.choice(own) for _ in range(r.randint(0, 60))), r.choice(["en", "fr", None]), source))
    rows += [(None, "en", "none"), ("", "en", "empty"), ("123 [] {}", "en", "none"), ("alone", "xx", "a"), ("other words", "xx", "b"), (None, "yy", "only"), ("wa " * 20_000, "en", "long")]
    return rows + [rows[3]] * 4


@pytest.mark.parametrize("block", [256, 3, 1])
def test_divergence_by_brute_force(spark, block):
    rows = corpus()
    want = brute(rows)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in want)
    assert found(spark, rows, block=block) == want


def test_divergence_keeps_the_first_terms_only(spark):
    rows = corpus(6)
    assert found(spark, rows, top=3, least=2) == brute(rows, least=2, top=3)


def test_divergence_of_ties_copies_and_nothing(spark):
    rows = [("b a c", "en", s) for s in "xyz"] * 2
    got = found(spark, rows)
    assert got == brute(rows) and {r[4] for r in got} == {0}  # equal sources: all values tie at 0, items in order
    assert found(spark, []) == set()
    assert found(spark, [(None, None, None)]) == set()


def test_divergence_by_sql(spark, db):
    db.execute(f"CREATE OR REPLACE TEMP TABLE want AS {ORACLE_SQL['op11_source_divergence']}")
    want = db.execute("SELECT lang, source, part, item, value, rank FROM want").fetchall()
    got = QUERIES["op11_source_divergence"](spark, "/root/testdata/sf0.001").select("lang", "source", "part", "item", "value", "rank")
    assert len(want) > 1000 and sorted(map(tuple, got.collect())) == sorted(want)
