"""Terms that are repeated, and those that conflict, in one pass."""

from lantern.operators import lookups


def test_repeated_terms_are_told_once_with_their_conflicts(spark):
    rows = [
        (1, "a", "is x", "p"), (1, "a", "IS X", "q"),  # one definition but for capitals
        (1, "b", "is x", "p"), (1, "b", "is y", "p"),  # one document
        (1, "c", "is y", "q"), (1, "c", "is x", "p"), (1, "c", None, "p"),
        (1, "d", None, "p"), (1, "d", None, "q"),
        (2, "a", "is x", "p"),
    ]
    df = spark.createDataFrame(rows, "subject_id long, term string, definition string, path string")
    got = {(r.subject_id, r.term): (r.times, r.definitions, r.documents, r.conflict) for r in lookups.repeated_terms(df).collect()}
    assert {k: v[3] for k, v in got.items()} == {(1, "a"): False, (1, "b"): False, (1, "c"): True, (1, "d"): False}
    assert got[(1, "c")][:3] == (3, ["is x", "is y"], ["p", "p", "q"])
    assert [r.term for r in lookups.definition_conflicts(df).collect()] == ["c"]
    assert sorted(r.term for r in lookups.definition_conflicts(df, raw=True).collect()) == ["a", "b", "c", "d"]
