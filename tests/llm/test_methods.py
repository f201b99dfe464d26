"""The methods at their seams: large draws, split groups, longer windows, long texts, given tables, and odd rows by value."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import COLUMNS, docs, edited, prose, table  # noqa: F401

import corpus_pipeline
from lantern.llm import decontaminate as D
from lantern.llm import doubling, jaccard, licenses, neighbours, pieces, queries, sharding, shared, suffixes, toxicity, urls

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_given_tables_agree_with_brute_force(spark, given):
    df = spark.createDataFrame(given, COLUMNS)
    assert table(jaccard.jaccard_join(df), "n_shingles", "component_id") == brute.components(given)
    assert table(doubling.substring_dedup(df, mode="digest"), "n_words", "n_removed", "kept") == brute.substring(given)
    assert table(suffixes.suffix_dedup(df, mode="digest"), "n_bytes", "n_removed", "n_spans", "kept") == brute.suffixes(given)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = D.decontaminate(df, spark.read.parquet(f"{SMALL}/benchmark.parquet")).withColumns({"n": F.size("items").cast("long"), "sha": F.sha2(F.array_join("items", ","), 256)})
    assert table(got, "n_words", "n_hit", "n", "sha", "contaminated") == brute.contamination(given, items)


@pytest.mark.parametrize("words", [4, 10, 24, 50])
def test_windows_of_other_lengths(spark, docs, words):  # noqa: F811
    r = random.Random(21)
    passage = prose(r, 90)
    rows = docs + [(5000 + i, " ".join([prose(r, r.randint(0, 40)), " ".join(passage.split()[i : i + 60]), prose(r, 20)])) for i in range(30)]
    got = doubling.substring_dedup(spark.createDataFrame(rows, COLUMNS), words=words, mode="digest")
    assert table(got, "n_words", "n_removed", "kept") == brute.substring(rows, words)


def test_hot_anchors_are_split(spark):
    """Many contexts of one anchor: shared windows left and right of it, of all lengths, are found when its group is split."""
    r = random.Random(22)
    core = "".join(r.choice("abcdefgh ") for _ in range(60))
    left, right = ("".join(r.choice("abcdefgh ") for _ in range(150)) for _ in range(2))
    rows = [(i, "".join(r.choice("xyz ") for _ in range(160)) + left[len(left) - (a := r.randint(0, 150)) :] + core + right[: r.randint(0, 150)] + "".join(r.choice("xyz ") for _ in range(160 + a % 3))) for i in range(60)]
    want = brute.suffixes(rows)
    for hot in (2, 7, 1000):
        got = suffixes.suffix_dedup(spark.createDataFrame(rows, COLUMNS), mode="digest", hot=hot)
        assert table(got, "n_bytes", "n_removed", "n_spans", "kept") == want


def test_large_draws_follow_the_law(monkeypatch):
    """The way for large populations, on sizes that numpy has too: same law, by mean, spread and distribution."""
    draw = np.random.default_rng(3)
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 10)
    monkeypatch.setattr(sharding, "FEW", 20)
    for good, bad, n in ((30_000, 90_000, 200), (100, 200_000, 5_000), (70_000, 50_000, 110_000), (3_000, 5_000, 600)):
        got = np.array([sharding.hypergeometric(draw, good, bad, n) for _ in range(1500)])
        want = draw.hypergeometric(good, bad, n, 200_000)
        assert abs(got.mean() - want.mean()) < 5 * want.std() / 1500**0.5 and abs(got.std() / want.std() - 1) < 0.12
        cuts = np.unique(np.quantile(want, [0.1, 0.3, 0.5, 0.7, 0.9]))
        share = lambda x: np.diff(np.concatenate([[0], np.searchsorted(np.sort(x), cuts, "right") / len(x), [1]]))
        assert ((share(got) - share(want)) ** 2 / np.maximum(share(want), 1e-9)).sum() * 1500 < 30


def test_matrix_of_more_rows_than_numpy_draws_from():
    blocks, shards = [3 * 10**9, 10**6, 7 * 10**9, 0, 5], [10**9 * 5, 10**9 * 5, 10**6 + 5]
    m = sharding.communication_matrix(blocks, shards, 9)
    assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == shards and (m >= 0).all()
    z = []
    for seed in range(200):
        k = int(sharding.communication_matrix([10**6, 2 * 10**9 - 10**6], [10**9, 10**9], seed)[0, 0])
        z.append((k - 5e5) / (10**6 / 4 * (1 - 10**6 / 2e9)) ** 0.5)
    assert abs(np.mean(z)) < 0.3 and 0.8 < np.std(z) < 1.2 and len(set(z)) > 150


def test_shards_are_uniform(spark):
    """Every row is in every shard equally often over seeds, also rows that are neighbours."""
    df = spark.createDataFrame([(i, "t") for i in range(60)], COLUMNS).repartition(4)
    seen = Counter((r.doc_id, r.shard) for seed in range(30) for r in sharding.shard(df, shards=3, seed=seed).collect())
    assert max(seen.values()) < 24 and min(seen.get((i, s), 0) for i in range(60) for s in range(3)) >= 1


def test_vectors_of_doubles(spark):
    """Scores are those of the original numbers, also where floats would round them, lose them or make them infinite."""
    r = np.random.default_rng(5)
    x = r.standard_normal((120, 8)) * 10.0 ** r.integers(-3, 3, (120, 1))
    x[7] = 1e60 * x[7]
    x[9] = 1e-60 * x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, [float("nan")] * 8), (501, None), (502, [0.0] * 8), (503, [float("-inf")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit("x"), "rank": F.lit(2)})
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()
    hit = total = 0
    for q in range(0, 120, 20):
        s = np.array([(x[q] * x[i]).sum() for i in range(120)])
        want = [i for i in np.lexsort((np.arange(120), -s)) if i != q][:5]
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert len(mine) == 5 and all(abs(g.score - s[g.vec_id]) <= 1e-12 * max(1, abs(s[g.vec_id])) for g in mine)
        hit, total = hit + len({g.vec_id for g in mine} & set(want)), total + 5
    assert hit / total >= 0.9
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_equal_sets_of_large_families(spark):
    """One family over several blocks, sparse and dense columns: links and classes as by brute force."""
    r = random.Random(23)
    base = prose(r, 60)
    rows = [(i, edited(r, base, r.choice([0, 0.005, 0.01, 0.02]))) for i in range(260)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, COLUMNS), block=40)
    assert table(got, "n_shingles", "component_id") == brute.components(rows)


def test_texts_longer_than_any_chunk(spark):
    r = random.Random(24)
    passage = prose(r, 50)
    long = " ".join(prose(r, 4000) for _ in range(130)) + " " + passage
    assert len(long.encode()) > 2 << 20
    rows = [(1, long), (2, long[-200_000:]), (3, prose(r, 30) + " " + passage), (4, prose(r, 60)), (5, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert table(jaccard.jaccard_join(df), "n_shingles", "component_id") == brute.components(rows)
    assert table(doubling.substring_dedup(df, mode="digest"), "n_words", "n_removed", "kept") == brute.substring(rows)
    assert table(suffixes.suffix_dedup(df, mode="digest"), "n_bytes", "n_removed", "n_spans", "kept") == brute.suffixes(rows)
    items = [(1, passage)]
    got = D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).withColumns({"n": F.size("items").cast("long"), "sha": F.sha2(F.array_join("items", ","), 256)})
    assert table(got, "n_words", "n_hit", "n", "sha", "contaminated") == brute.contamination(rows, items)
    p = pieces.pieces(queries.tokenizer())
    ids = table(pieces.encode(df, queries.tokenizer()), "ids", "decoded", "n_differ")
    assert all(ids[i] == (p.library.encode(t or ""), p.library.decode(p.library.encode(t or "")), 0) for i, t in rows)
    sizes = table(sharding.shard(df, shards=2), "size", "text_crc32")
    assert all(sizes[i] == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)


def test_long_items_and_items_without_an_id(spark):
    r = random.Random(25)
    item = prose(r, 300)
    part = " ".join(item.split()[100:140])
    rows = [(1, part), (2, item), (3, prose(r, 50)), (4, "solo aquí " + part)]
    items = [(7, item), (None, rows[2][1]), (8, "")]
    want = brute.contamination(rows, [(i, t) for i, t in items if i is not None])
    for block in (1 << 24, 400):
        got = D.decontaminate(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
        found = {r.doc_id: (r.n_hit, r.items, r.contaminated) for r in got.collect()}
        assert found[3] == (50, [], True)
        assert all(found[i] == (want[i][1], ["7"], True) for i in (1, 2, 4))


ODD = [(1, "word " * 60), (1, "word " * 60), (1, "other"), (None, "word " * 60), (None, None), (2, None), (3, ""), (4, "word " * 60)]


def _odd(spark):
    wide = COLUMNS + ", key long, hash int, id string, doc string, n long, spans string, at int, found string, shard int, kept string, p_toxic double"
    return spark.createDataFrame([(*r, *[None] * 11) for r in ODD], wide)


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_odd_rows_by_value(spark):
    df = _odd(spark)
    # Rows of an id share its links; null ids have none; equal sets are one class.
    assert counted(jaccard.jaccard_join(df), "doc_id", "n_shingles", "component_id") == Counter({(1, 1, 1): 3, (None, 1, None): 1, (None, 0, None): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 1, 1): 1})
    # A null id counts as larger than all others; rows of one id take nothing from each other.
    assert counted(doubling.substring_dedup(df), "doc_id", "n_words", "n_removed") == Counter({(1, 60, 0): 2, (1, 1, 0): 1, (None, 60, 60): 1, (None, 0, 0): 1, (2, 0, 0): 1, (3, 0, 0): 1, (4, 60, 60): 1})
    assert counted(suffixes.suffix_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans") == Counter({(1, 300, 300, 1): 2, (1, 5, 0, 0): 1, (None, 300, 300, 1): 1, (None, 0, 0, 0): 1, (2, 0, 0, 0): 1, (3, 0, 0, 0): 1, (4, 300, 300, 1): 1})
    items = spark.createDataFrame([(1, "other"), (2, None)], "item_id long, text string")
    assert counted(D.decontaminate(df, items), "doc_id", "n_words", "n_hit", "contaminated") == Counter({(1, 60, 0, False): 2, (1, 1, 1, True): 1, (None, 60, 0, False): 1, (None, 0, 0, False): 1, (2, 0, 0, False): 1, (3, 0, 0, False): 1, (4, 60, 0, False): 1})
    n = len(pieces.pieces(queries.tokenizer()).library.encode("word " * 60))
    assert counted(pieces.encode(df, queries.tokenizer()), "doc_id", "n_tokens")[(1, n)] == 2 and counted(pieces.encode(df, queries.tokenizer()), "doc_id", "n_tokens")[(None, 0)] == 1
    assert counted(sharding.shard(df, shards=3), "doc_id", "size") == Counter({(1, 301): 2, (1, 6): 1, (None, 301): 1, (None, 1): 1, (2, 1): 1, (3, 1): 1, (4, 301): 1})
    said = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 0, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    judged = toxicity.toxicity(df, said, toxicity.categories(), "toxic")
    assert counted(judged, "doc_id", "is_toxic")[(1, False)] == 3 and judged.columns.count("p_toxic") == 1


def test_ties_of_threshold_and_cosine(spark):
    p, y = np.array([0.9, 0.5, 0.5, 0.5, 0.1]), np.array([1.0, 1.0, 1.0, 0.0, 0.0])
    assert toxicity.threshold(p, y) <= 0.5  # equal probabilities are on one side
    rows = [(1, "a/LICENSE", "Alpha beta gamma delta."), (2, "a/COPYING", "Alpha beta gamma delta."), (3, "a/x", "q"), (4, "y", "q"), (5, "LICENSE", "Alpha beta gamma delta.")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = licenses.license_scan(df, F.col("path").rlike("LICENSE$|COPYING$"), templates=[("B", "alpha beta gamma delta"), ("A", "alpha beta gamma delta")])
    assert {r.doc_id: (r.license, r.how, r.license_dir) for r in got.collect()} == {1: ("B", "own", "a"), 2: ("B", "own", "a"), 3: ("B", "inherited", "a"), 4: ("B", "inherited", ""), 5: ("B", "own", "")}


def test_cosines_are_those_of_the_formula(spark):
    """The licence of a one-line file, by the plain formula over all templates."""
    r = random.Random(26)
    rows = [(i, f"d{i}/x.txt", edited(r, licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1].rstrip("."), 0.15)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {x.doc_id: (x.license, x.cosine) for x in licenses.license_scan(df, F.lit(False), least=0.3).collect()}
    words = lambda t: brute.ALNUM.findall(brute.lower(t))
    df_of = Counter(w for _, _, t in rows for w in set(words(t)))
    idf = lambda w: np.log((1 + len(rows)) / (1 + df_of[w])) + 1
    known = {w for _, t in licenses.TEMPLATES + licenses.FULL for w in words(t)}

    def cosine(a, b):
        x, y = Counter(words(a)), Counter(words(b))
        wx = {w: n * (idf(w) if w in known else np.log(1 + len(rows)) + 1) for w, n in x.items()}
        wy = {w: n * idf(w) for w, n in y.items()}
        unknown = sum(x[w] * (np.log(1 + len(rows)) + 1) ** 2 for w in x if w not in known)
        long = np.sqrt(sum(v * v for w, v in wx.items() if w in known) + unknown)
        return sum(v * wy.get(w, 0) for w, v in wx.items()) / long / np.sqrt(sum(v * v for v in wy.values()))

    for i, _, t in rows:
        if "." in t or ";" in t or ":" in t:  # of several pieces: the best run counts, which is no worse than the whole
            continue
        best = max((cosine(t, b), -k) for k, (_, b) in enumerate(licenses.TEMPLATES))
        if best[0] >= 0.9:
            assert found[i][0] == licenses.TEMPLATES[-best[1]][0] and abs(found[i][1] - best[0]) < 1e-9


def test_pipeline_stages_on_odd_tables(spark):
    row = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f " * 30), (1, "a b c d e f " * 30), (None, "a b c d e f " * 30), (2, None), (3, ""), (None, None), (5, "x y z")]
    docs = spark.createDataFrame([(i, t, None, "web", len(t or "")) for i, t in rows], row)
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = shared.cut(stage(spark, df, SMALL))
            assert name == "sentencepiece" or out.columns == docs.columns
            assert out.count() <= df.count()
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, "a b c d e f " * 30), (2, None), (3, ""), (None, None), (5, "x y z")])


def test_pipeline_drops_toxic_rows(spark, tmp_path):
    r = random.Random(27)
    rows = [(i, prose(r, 60) + (" idiot moron scum" if i % 4 == 0 else ""), "en", "web", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1 - i % 2, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()} == {i for i in range(400) if i % 4}


def test_url_verdicts_by_brute_force(spark):
    """Verdicts where no rule fits are those of the scores and the threshold; rules, hosts and paths by SQL elsewhere."""
    got = urls.url_filter(spark.read.parquet(f"{SMALL}/pages.parquet"), queries.URL_RULES).collect()
    assert got and all(r.verdict == ("allow" if r.threshold is None or r.score >= r.threshold else "block") for r in got if r.rule is None)


def test_hosts_paths_rules_and_set_sizes_by_sql(spark):
    """What SQL can say of the URL filter, the shards and the sets, on the given tables."""
    import duckdb

    db = duckdb.connect()
    for name in ("pages", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    small = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda rule: "({0} = h OR ends_with(h, '.' || {0})) AND starts_with(p, {1})".format(*(f"'{x}'" for x in (rule.split("/")[0], rule[rule.index("/") :])))
    rules = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in sorted(queries.URL_RULES, key=lambda x: -len(x[1])))
    want = db.execute(
        f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages), h AS (SELECT *, regexp_extract(r, '^[^/?#]*') AS raw FROM r),
        x AS (SELECT page_id, {small.format('raw')} AS h, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS p FROM h) SELECT page_id, h, p, CASE {rules} END FROM x"""
    ).fetchall()
    got = queries.op4_url_filter(spark, SMALL).select("page_id", "host", "path", "rule").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    want = db.execute(
        f"""WITH w AS (SELECT doc_id, regexp_extract_all({small.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
        SELECT doc_id, CASE WHEN len(w) >= 4 THEN len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]))) ELSE least(len(w), 1) END FROM w"""
    ).fetchall()
    assert Counter(tuple(r) for r in queries.op1_ngram_jaccard(spark, SMALL).select("doc_id", "n_shingles").collect()) == Counter(want)
    want = db.execute("SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 FROM documents").fetchall()
    assert Counter(tuple(r) for r in queries.op2_shard_uniform(spark, SMALL).select("doc_id", "size").collect()) == Counter(want)
