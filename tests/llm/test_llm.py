"""The training-data operators against brute force, round trips and held-out rows, and on odd input."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lantern.llm import decontaminate as D
from lantern.llm import doubling, jaccard, kernels, licenses, neighbours, pieces, queries, sharding, shared, suffixes, toxicity, urls

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in is it on as for was with by at from or an be this that which".split() + [f"w{i}" for i in range(400)] + ["Été", "ñandú", "日本", "a.b", "x,"]
COLUMNS = "doc_id long, text string"


def prose(r, n):
    return " ".join(r.choice(WORDS[:20] if r.random() < 0.4 else WORDS) for _ in range(n))


def edited(r, text, share):
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def docs():
    """Originals, exact and near copies, shared passages, repeated lines, and everything odd."""
    r = random.Random(3)
    out = [prose(r, r.randint(1, 300)) for _ in range(40)]
    hot = prose(r, 120)
    passage = prose(r, 60)
    out += [edited(r, hot, r.choice([0, 0.01, 0.02, 0.05, 0.1, 0.2])) for _ in range(80)]
    out += [prose(r, 40) + " " + passage + "\n" + prose(r, r.randint(0, 40)) for _ in range(25)]
    out += [None, None, "", "", " ", "\n\t", "one", "one", "One", "a b c", "A b c", "a b c d", "ab " * 400, "ab " * 401, "é" * 500, "é" * 400 + "x", "\x00 b", "▁a  b", "日本 " * 100, "x" * 3000]
    out += [passage, passage, "  spaced \r\n lines  here " * 20, hot.upper()]
    r.shuffle(out)
    return [(i * 3 - 20, t) for i, t in enumerate(out)]


def table(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_jaccard_join(spark, docs):
    got = jaccard.jaccard_join(spark.createDataFrame(docs, COLUMNS))
    assert table(got, "n_shingles", "component_id") == brute.components(docs)
    few = jaccard.jaccard_join(spark.createDataFrame(docs, COLUMNS), block=7)
    assert table(few, "component_id", "n_links") == table(got, "component_id", "n_links")
    sets = {i: brute.shingles(t) for i, t in docs}
    links = {i: sum(1 for j, b in sets.items() if j != i and a and b and 100 * len(a & b) >= 85 * len(a | b)) for i, a in sets.items()}
    assert {i: n for i, (n,) in table(got, "n_links").items()} == links


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_agree_in_a_part(percent):
    """Sets at the very bound still share a signature, small ones too; long ones have no more than their share of them."""
    r = np.random.default_rng(1)
    parts = jaccard.Parts(jaccard.Fraction(percent, 100))
    for n in [*range(1, 60), 100, 333, 5000]:
        for _ in range(20 if n < 1000 else 2):
            a = np.sort(r.integers(0, 2**63, n, dtype=np.uint64))
            b = np.delete(a, r.choice(n, n * (100 - percent) // 100, replace=False))
            x, y = (parts.signatures([s], np.array([1]))[0].tolist() for s in (a, b))
            assert len(a) == len(b) or set(x) & set(y)
            assert len(x) <= n + 20


def test_substring_dedup(spark, docs):
    got = doubling.substring_dedup(spark.createDataFrame(docs, COLUMNS), mode="digest")
    assert table(got, "n_words", "n_removed", "kept") == brute.substring(docs)


def test_suffix_dedup(spark, docs):
    want = brute.suffixes(docs)
    for hot in (suffixes.HOT, 3):
        got = suffixes.suffix_dedup(spark.createDataFrame(docs, COLUMNS), mode="digest", hot=hot)
        assert table(got, "n_bytes", "n_removed", "n_spans", "kept") == want
    text = table(suffixes.suffix_dedup(spark.createDataFrame(docs, COLUMNS), mode="text"), "kept", "n_removed")
    assert all(len(k.encode()) - (want[i][0] - want[i][1]) in range(8) for i, (k, _) in text.items())


def test_maximal_repeats_of_one_anchor():
    """Three texts share a long string, two of them a longer one: both groups come out, with all members."""
    right = np.arange(3)
    found = [(sorted(m.tolist()), a, b) for m, a, b in suffixes.maximal_repeats(right, np.array([200, 120]), np.array([2, 0, 1]), np.array([90, 150]), 200)]
    assert ([0, 1], 150, 200) in found and ([0, 1, 2], 90, 120) in found


def test_decontamination(spark, docs):
    r = random.Random(5)
    texts = [t for _, t in docs if t and len(t.split()) > 30]
    items = [(i, " ".join(r.choice(texts).split()[5:30])) for i in range(12)] + [(90, "one"), (91, "A b"), (92, None), (93, "..."), (94, prose(r, 20)), (95, r.choice(texts).upper())]
    want = brute.contamination(docs, items)
    for block in (1 << 24, 300):
        got = D.decontaminate(spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
        got = got.withColumns({"n": F.size("items").cast("long"), "sha": F.sha2(F.array_join("items", ","), 256)})
        assert table(got, "n_words", "n_hit", "n", "sha", "contaminated") == want


def test_fm_index():
    r = np.random.default_rng(2)
    text = r.integers(0, 5, 3000)
    text[-1] = 0
    index = D.FMIndex(text)
    for n in (1, 2, 5):
        ask = np.zeros((40, 6), np.int32)
        ask[:, 6 - n :] = r.integers(1, 6, (40, n))
        lo, hi = index.search(ask)
        for i in range(40):
            want = [p for p in range(len(text) - n + 1) if (text[p : p + n] == ask[i, 6 - n :]).all()]
            assert sorted(index.locate(np.arange(lo[i], max(hi[i], lo[i]))).tolist()) == want


def test_pieces(spark, docs):
    p = pieces.Pieces(queries.tokenizer())
    got = table(pieces.encode(spark.createDataFrame(docs, COLUMNS), queries.tokenizer()), "n_tokens", "ids", "decoded")
    for i, t in docs:
        ids = p.library.encode(t or "")
        assert got[i] == (len(ids), ids, p.library.decode(ids))
    assert got[[i for i, t in docs if t == "日本 " * 100][0]][2] == "日本 " * 100


def test_sharding(spark, docs):
    rows = docs + docs[:5]
    for n in (8, 3):
        got = sharding.shard(spark.createDataFrame(rows, COLUMNS).repartition(5), shards=n).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        sizes = Counter(r.shard for r in got)
        assert set(sizes) == set(range(n)) and max(sizes.values()) - min(sizes.values()) <= 1
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s])) for s in sizes)
        by = dict(rows)
        import zlib

        assert all(r.size == len((by[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) for r in got)


def test_communication_matrix():
    m = sharding.communication_matrix([10, 0, 7, 30], [16, 16, 15], 4)
    assert m.sum(axis=1).tolist() == [10, 0, 7, 30] and m.sum(axis=0).tolist() == [16, 16, 15]
    mean = np.mean([sharding.communication_matrix([10, 20], [15, 15], s)[0, 0] for s in range(400)])
    assert abs(mean - 5) < 0.35


def test_neighbours(spark):
    r = np.random.default_rng(7)
    x = r.standard_normal((600, 64)).astype(np.float32)
    x[50:80] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [float("inf")] + [1.0] * 63), (904, [None] + [1.0] * 63), (905, [1.0]), (906, [])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    d = x.astype(np.float64)
    hit = total = 0
    for q in range(0, 600, 20):
        s = (d * d[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in mine] == list(range(1, 21)) and all(abs(g.score - s[g.vec_id]) < 1e-12 for g in mine)
        hit += len({g.vec_id for g in mine} & set(want))
        total += 20
    assert hit / total >= 0.98 and max(g.vec_id for g in got) < 600


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect()
    assert [(g.query_id, g.vec_id) for g in got] == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_url_rules_and_parts(spark):
    rows = [(1, "http://A.Example.com/en/x?q#f"), (2, "https://www.example.com/en/1"), (3, "x://b.net/es/#t"), (4, "http://net"), (5, None), (6, "no scheme.com/"), (7, "http://a.com"), (8, "http://notexample.com/en/"), (9, "http://q.net/de/?a=://b"), (10, "")]
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == {
        1: ("a.example.com", "/en/x", "example.com/en/"), 2: ("www.example.com", "/en/1", "www.example.com/en/"), 3: ("b.net", "/es/", "net/es/"), 4: ("net", "", None),
        5: ("", "", None), 6: ("", "", None), 7: ("a.com", "", None), 8: ("notexample.com", "/en/", "com/"), 9: ("q.net", "/de/", None), 10: ("", "", None),
    }
    assert [got[i].verdict for i in (1, 2, 3, 8)] == ["block", "allow", "block", "allow"]


def test_url_model_tells_held_out_urls(spark):
    r = random.Random(1)
    good = ["".join(r.choice("abcde") for _ in range(8)) for _ in range(400)]
    bad = ["".join(r.choice("vwxyz") for _ in range(8)) for _ in range(400)]
    rows = [(i, f"http://{w}.{'com' if i % 3 else 'org'}/") for i, w in enumerate(good)] + [(1000 + i, f"http://{w}.{'net' if i % 3 else 'org'}/") for i, w in enumerate(bad)]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "com/"), ("block", "net/")]).where("rule is null").collect()
    right = sum((r.page_id < 1000) == (r.verdict == "allow") for r in got)
    assert right / len(got) > 0.95


def test_chain_is_a_distribution():
    key, n = np.unique(np.random.default_rng(0).integers(2, urls.ALPHABET, 500), return_counts=True)
    chain = urls.Chain(key, n.astype(float))
    for context in (0, 5, 77):
        assert abs(np.exp(chain.logs(context * urls.ALPHABET + np.arange(urls.ALPHABET))).sum() - 1) < 1e-9


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(9)
    rows, said = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [r.choice(WORDS) for _ in range(60)]
        for _ in range(3 if toxic else 0):
            words[r.randrange(60)] = r.choice(["idiot", "moron", "scum", "trash"])
        rows.append((i, " ".join(words)))
        if i < 600:
            said.append((i, 0 if i % 5 == 0 else 1, int(toxic) if r.random() > 0.03 else 1 - int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "idiot moron scum")]
    got = toxicity.toxicity(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(said, "doc_id long, quality int, toxic int"), toxicity.categories(), "toxic")
    flags = {r.doc_id: r.is_toxic for r in got.collect()}
    assert all(flags[i] == (i % 6 == 0) for i in range(600, 900)) and not flags[2000] and not flags[2001] and flags[2002]
    none = toxicity.toxicity(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([], "doc_id long, quality int, toxic int"), toxicity.categories(), "toxic")
    assert none.where("is_toxic").isEmpty() and none.count() == len(rows)


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", f"{mit}"), (2, "a/b/c/x.txt", "plain words"), (3, "a/b/LICENSE", "nothing known"), (4, "a/d/y.txt", f"text\n{gpl}\nmore text"), (5, "z/q.txt", "text"), (6, None, None), (7, "a/d/e/LICENSE", gpl), (8, "a/d/e/f/g.txt", ""), (9, "top.txt", "x")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.how, r.license_dir) for r in licenses.license_scan(df, F.col("path").rlike("LICENSE$")).collect()}
    assert got == {
        1: ("MIT", "own", "a"), 2: ("MIT", "inherited", "a"), 3: ("MIT", "inherited", "a"), 4: ("GPL-3.0", "own", "a/d"), 5: (None, None, None),
        6: (None, None, None), 7: ("GPL-3.0", "own", "a/d/e"), 8: ("GPL-3.0", "inherited", "a/d/e"), 9: (None, None, None),
    }


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3), (50, 2)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 0, 100: 100, 101: 100}


def test_minimizers_cover_every_window():
    h = kernels.mix(np.random.default_rng(4).integers(0, 40, 500).astype(np.uint64))
    at = set(kernels.minimizers(h, np.ones(491, bool), 10).tolist())
    assert all(any(p in at for p in range(s, s + 10)) for s in range(491))


OPERATORS = {
    "jaccard": lambda s, d: jaccard.jaccard_join(d),
    "sharding": lambda s, d: sharding.shard(d),
    "substring": lambda s, d: doubling.substring_dedup(d),
    "suffix": lambda s, d: suffixes.suffix_dedup(d),
    "pieces": lambda s, d: pieces.encode(d, queries.tokenizer()),
    "contamination": lambda s, d: D.decontaminate(d, s.createDataFrame([(1, "a b c")], "item_id long, text string")),
    "toxicity": lambda s, d: toxicity.toxicity(d, s.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"), toxicity.categories(), "toxic"),
    "licenses": lambda s, d: licenses.license_scan(d.withColumn("path", F.lit("a/b")), F.lit(None).cast("boolean")),
    "urls": lambda s, d: urls.url_filter(d, queries.URL_RULES, "doc_id", "text"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(spark, name):
    """Empty tables, null ids, repeated rows and ids, and columns named like the operators' own."""
    wide = COLUMNS + ", key long, hash int, id string, doc string, n long, spans string, at int, found string, shard int, bucket int, label string"
    assert OPERATORS[name](spark, spark.createDataFrame([], COLUMNS)).count() == 0
    long = "word " * 100
    rows = [(1, long), (1, long), (1, "other"), (None, long), (None, None), (2, None), (3, ""), (4, long)]
    rows = [(*r, *[None] * 11) for r in rows]
    assert OPERATORS[name](spark, spark.createDataFrame(rows, wide)).count() == len(rows)


def test_pipeline(spark):
    """Stage by stage against brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = set("trash clown idiot scum worthless moron pathetic loser disgusting stupid".split())
    for name, stage in corpus_pipeline.STAGES:
        out = shared.cut(stage(spark, docs, SF))
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "sentencepiece":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        after = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "toxicity":  # so few labels tell nothing, and then nothing goes
            assert all(any(b in brute.lower(before[i]) for b in bad) for i in gone)
        if name == "ngram_jaccard_join":
            words = {i: brute.SPACED.findall(brute.lower(t or "")) for i, t in before.items()}
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
            near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
            assert all(any(near(sets[i], sets[j]) for j in sets if j != i) for i in gone)
            assert not any(near(sets[i], sets[j]) for i in after for j in after if i < j)
        if name == "suffix_array_dedup":
            want = brute.suffixes(list(before.items()))
            assert all(len(t.encode()) - (want[i][0] - want[i][1]) in range(0, 3 * want[i][2] * 2 + 1) for i, t in after.items()) and not gone
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert gone == {i for i, v in brute.contamination(list(before.items()), items).items() if v[4]}
        docs = out
