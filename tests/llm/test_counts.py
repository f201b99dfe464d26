"""Token counts against the sentencepiece library."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from lantern.llm import counts, pieces
from lantern.llm.queries import QUERIES, tokenizer

MODEL = tokenizer()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_proved_strings_are_all_that_the_library_gives_one_token(library):
    p = pieces.pieces(MODEL)
    whole = counts.proved(p)
    names = [t[1:] for t in p.id if t[0] == "▁" and len(t) > 1]
    want = {n for n, ids in zip(names, library.encode(names), strict=True) if len(ids) == 1}
    assert whole - {""} == want and len(want) > 10_000


def test_counts_by_the_library(spark, library):
    r = random.Random(2)
    words = ["the", "of", "Zebra", "été", "日本語", "naïve", "xqzzk", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "▁▁a", "\n", "\n\n", " ", "  ", "\t", "\r\n", "\x00", "🙂", "a" * 60, "1234567"]
    texts = [r.choice(["", " "]).join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts += [None, "", " ", "  ", "\n", "▁", "x" * 30_000, "ab cd " * 3000, "the the", "the the"]
    rows = [(i if i % 7 else None, t, "clash", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")
    got = counts.token_counts(df.coalesce(1), MODEL, limit=20).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 20) for i, t, *_ in rows]
    assert [tuple(g[:4]) for g in got] == want
    assert sum(g["n_differ"] for g in got) == 0 and 0 < sum(g["n_whole"] for g in got) < sum(g["n_tokens"] for g in got)
    assert counts.token_counts(df.limit(0), MODEL).collect() == []


def test_long_texts_are_counted_in_stretches(library):
    r = random.Random(3)
    costs = counts.Costs(pieces.pieces(MODEL), counts.proved(pieces.pieces(MODEL)))
    for _ in range(40):
        text = "".join(r.choice(["the", "xqz", " ", " ", "  ", "\n", "▁", "é"]) for _ in range(400))
        for size in (1, 7, 50):
            cut = list(counts.stretches(text, size))
            assert " ".join(cut) == text and (size == 50 or len(cut) > 2)
            assert costs.count(cut)[0].sum() == len(library.encode(text)) == costs.count([text])[0][0]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(counts, "KEEP", 3)
    monkeypatch.setattr(counts, "STRETCH", 5)
    costs = counts.Costs(pieces.pieces(MODEL), frozenset())
    texts = ["qzx wvq pqy zzkq " * 3, "", "qzx mmq " + "k" * 90, "a b c d e f g", "a  b\n qzx"]
    for _ in range(3):
        n, direct = costs.count(texts)
        assert n.tolist() == [len(library.encode(t)) for t in texts] and not direct.any()


def test_query_counts_whole_texts(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op13_token_counts"](spark, "/root/testdata/sf0.001").where(F.col("n_differ") == 0).collect()
    assert len(got) == len(docs)
    for g in got:
        n = len(library.encode(docs[g["doc_id"]] or ""))
        assert (g["n_bytes"], g["n_tokens"], g["over_limit"]) == (len((docs[g["doc_id"]] or "").encode()), n, n > 4096)
