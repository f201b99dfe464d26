"""Cases in which the training-data operators once did less than the whole job."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_llm import prose

import corpus_pipeline
from lantern.llm import licenses, toxicity, urls

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], ROW)


def test_near_copies_are_judged_by_row(spark):
    """Repeated rows, copies without an id and different texts of one id: one row of each group stays, and nothing else goes."""
    r = random.Random(11)
    a, b, c, d, e = (prose(r, 80) for _ in range(5))
    rows = [(1, a), (1, a), (1, a), (None, a), (2, b), (2, c), (None, d), (None, d), (5, e), (4, e + " end"), (None, ""), (None, ""), (7, None), (7, None)]
    out = corpus_pipeline.drop_near_copies(spark, corpus(spark, rows), "").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(1, a), (2, b), (2, c), (None, d), (4, e + " end"), (None, ""), (None, ""), (7, None), (7, None)])
    left = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(out, ROW), "").collect()
    assert {a, b, c, d} <= {r.text for r in left}


def test_contaminated_rows_are_judged_by_row(spark, tmp_path):
    r = random.Random(12)
    item, clean = prose(r, 40), prose(r, 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, clean), (3, item), (3, clean), (4, clean), (4, clean)]
    out = corpus_pipeline.drop_contaminated(spark, corpus(spark, rows), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(None, clean), (3, clean), (4, clean), (4, clean)])


def test_a_labelled_id_of_many_rows_does_not_crowd_out_the_others(spark):
    r = random.Random(13)
    texts = [(i, prose(r, 40) + (" idiot moron scum" if i % 3 == 0 else "")) for i in range(1, 121)]
    rows = texts + [(0, f"plain {i}") for i in range(400)]
    said = [(0, 1, 0)] + [(i, 1, int(i % 3 == 0)) for i, _ in texts]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(said, "doc_id long, quality int, toxic int"), toxicity.categories(), "toxic", sample=150)
    assert {r.doc_id for r in got.where("is_toxic").collect()} == {i for i, _ in texts if i % 3 == 0}


def test_url_models_read_query_and_fragment_and_urls_without_a_scheme(spark):
    r = random.Random(14)
    word = lambda letters: "".join(r.choice(letters) for _ in range(10))
    rows = [(i, f"http://a.com/?q={word('abcde')}") for i in range(300)] + [(1000 + i, f"http://a.net/?q={word('vwxyz')}") for i in range(300)]
    rows += [(2000, f"http://a.org/?q={word('abcde')}"), (2001, f"http://a.org/?q={word('vwxyz')}"), (2002, f"http://a.org/#{word('abcde')}"), (2003, f"http://a.org/#{word('vwxyz')}"), (2004, word("abcde")), (2005, word("vwxyz"))]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "com/"), ("block", "net/")]).where("page_id >= 2000")
    assert {r.page_id: r.verdict for r in got.collect()} == {i: "block" if i % 2 else "allow" for i in range(2000, 2006)}


def test_url_models_tell_letters_and_long_contexts_apart(spark):
    """Letters outside ASCII, and words that only differ in what stands more than three characters before."""
    r = random.Random(15)
    word = lambda letters: "".join(r.choice(letters) for _ in range(8))
    rows = [(i, f"http://a.com/{word('абвгд')}") for i in range(300)] + [(1000 + i, f"http://a.net/{word('жзийк')}") for i in range(300)]
    rows += [(2000 + i, f"http://a.org/{word('жзийк' if i % 2 else 'абвгд')}") for i in range(20)]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "com/"), ("block", "net/")])
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got.where("page_id >= 2000").collect())
    said = [("com", "a" + "xyz" + "m", "b" + "xyz" + "n"), ("net", "a" + "xyz" + "n", "b" + "xyz" + "m")]
    rows = [(i, f"http://{i}.{end}/{two[i % 2]}") for end, *two in said for i in range(300)] + [(9000 + i, f"http://q.org/{w}") for i, w in enumerate(["axyzm", "axyzn", "bxyzn", "bxyzm"])]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "com/"), ("block", "net/")])
    score = {r.page_id: r.score for r in got.where("page_id >= 9000").collect()}
    assert min(score[9000], score[9002]) > max(score[9001], score[9003])


def test_dealt_url_scores_are_those_of_one_model(spark, monkeypatch):
    r = random.Random(16)
    monkeypatch.setattr(urls, "HELD", 50)
    texts = ["".join(r.choice("ab/é") for _ in range(r.randint(1, 30))) for _ in range(120)]
    rows = [(i, t, int(i % 3 == 0), int(i % 3 == 1)) for i, t in enumerate(texts)]
    found, both = urls.scored(spark.createDataFrame(rows, "key long, url string, good long, bad long"))
    grams = lambda some: np.concatenate([g for _, _, _, g in urls._grams(pa.array(some))])
    good, bad = (urls.Chain(*[x.astype(t) for x, t in zip(np.unique(grams([t for i, t in enumerate(texts) if i % 3 == k]), return_counts=True), (int, float))]) for k in (0, 1))
    got = {r.key: r.score for r in found.collect()}
    assert both and all(abs(got[i] - (good.logs(g := grams([t])) - bad.logs(g)).mean()) < 1e-9 for i, t in enumerate(texts))


def test_wrapped_headers_and_whole_licence_files(spark):
    r = random.Random(17)
    mit, gpl, apache = (dict(licenses.FULL)[n] for n in ("MIT", "GPL-3.0", "Apache-2.0"))
    bsd = "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n */\nint x;"
    gpl2 = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\nimport x"
    inside = f"{prose(r, 20)}. Licensed under the Apache License, Version 2.0. {prose(r, 20)}"
    rows = [(1, "m/LICENSE", mit.replace("<year> <copyright holders>", "2020 Someone")), (2, "m/a.txt", "x"), (3, "g/LICENSE", gpl), (4, "p/LICENSE", apache), (5, "q/a.c", bsd), (6, "q/b.py", gpl2), (7, "q/c.txt", inside)]
    rows += [(100 + i, f"z/{i}.txt", prose(r, 100)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.how) for r in licenses.license_scan(df, F.col("path").rlike("LICENSE$")).collect()}
    assert [got[i] for i in range(1, 8)] == [("MIT", "own"), ("MIT", "inherited"), ("GPL-3.0", "own"), ("Apache-2.0", "own"), ("BSD-3-Clause", "own"), ("GPL-2.0", "own"), ("Apache-2.0", "own")]
    assert all(got[i] == (None, None) for i in got if i >= 100)
