"""Copies of a question's vector are evidence; only the question's own row is left out."""

from lantern.plans import QUERIES


def test_copies_of_the_question_count(spark, tmp_path):
    a, b = [1.0, 0.0], [0.6, 0.8]
    rows = [(1, 1, a), (2, 1, a), (3, 1, b), (4, 2, b), (5, 2, b), (6, 2, a)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.query_id: (r.best, r.margin) for r in QUERIES["retrieval_confidence"](spark, str(tmp_path)).collect()}
    assert got == {1: (1.0, 0.4), 2: (1.0, 0.4)}
    levels = {r.query_id: (r.first_level, r.second_level) for r in QUERIES["cascade_second_pass"](spark, str(tmp_path)).collect()}
    assert levels == {1: ("high", "high"), 2: ("high", "high")}
