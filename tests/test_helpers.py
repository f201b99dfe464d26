"""Smaller operators, each by golden values."""

import pytest
from pyspark.sql import functions as F

from lantern.functions import text as X
from lantern.operators import checks, evidence, ingest, lookups, metrics, quality, reconcile, retrieval, verify
from lantern.sources import files


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def test_shares_usage_and_deadlines(spark):
    assert [value(spark, metrics.percentage(F.lit(a), F.lit(b))) for a, b in ((3, 4), (0, 5), (1, 0))] == ["75.0 %", "0.0 %", "n/a"]
    tokens, guessed = evidence.usage(F.col("c"), F.col("n"))
    df = spark.createDataFrame([(36, None), (37, None), (100, 7)], "c int, n long")
    assert [tuple(r) for r in df.select(tokens, guessed).collect()] == [(10, True), (11, True), (7, False)]
    assert [value(spark, verify.late(F.lit(v), F.lit(1000), F.lit("podada"))) for v in (3000, 3001)] == ["podada", "sin_verificar"]


def test_borders_of_a_page(spark):
    page = "ab\n  Cabecera  \n\nsegunda\ntercera\n" + "x" * 91 + "\nfinal\nfin"
    assert value(spark, ingest.border_lines(F.lit(page))) == ["Cabecera", "segunda", "final"]  # the long line is one of the last two, so nothing takes its place
    assert value(spark, ingest.border_lines(F.lit("una linea"))) == ["una linea"] and value(spark, ingest.border_lines(F.lit(""))) == []


def test_lines_that_a_page_cut():
    long = "Una frase bastante larga que sigue en la"
    assert ingest.joined_lines(f"{long}\nlínea que viene y\nfin.") == f"{long} línea que viene y fin."
    for text in (f"{long}\nOtra", f"{long}.\nlínea", f"corta\nlínea", f"{long}\n1 línea", f"{long} (x)\nlínea", f"{long}\nx = línea;", f"{long}:\nlínea", "", "\n\n"):
        assert ingest.joined_lines(text) == text


def test_gates_of_documents(spark):
    got = [value(spark, ingest.empty_gate(F.lit("x" * n), F.lit(p))) for n, p in ((199, 1), (200, 1), (200, 6), (240, 6), (240, 0))]
    assert got == ["too short", None, "empty pages", None, None]
    df = spark.createDataFrame([("k", "pdf", "b"), ("k", "text", "z"), ("k", "text", "a"), ("j", "odd", "x")], "key string, kind string, path string")
    assert {(r.key, r.path) for r in ingest.choose_source(df, "key", "kind").where("chosen").collect()} == {("k", "a"), ("j", "x")}


def test_contradictions(spark):
    rows = [(1, "contradiction", 0.99, 0.9, False), (2, "contradiction", 0.99, 0.9, True), (3, "entailment", 0.99, 0.9, False), (4, "contradiction", 0.1, 0.9, False), (5, "contradiction", 0.99, 0.0, False), (6, "contradiction", quality.CONTRADICTION, quality.OVERLAP, False)]
    df = spark.createDataFrame(rows, "i int, label string, probability double, overlap double, is_code boolean")
    assert sorted(r.i for r in quality.contradictions(df).collect()) == [1, 6]


def test_runs_of_one_question(spark):
    rows = [("a", "x", ["c"]), ("a", "y", ["c", "d"]), ("a", "x", ["d", "c"]), ("b", "x", []), ("b", "x", [])]
    got = evidence.run_dispersion(spark.createDataFrame(rows, "q string, t string, claims array<string>"), "q", "t", "claims").collect()
    assert sorted(tuple(r) for r in got) == [("a", 3, 2, 2, 3, False), ("b", 2, 1, 1, 1, True)]


def test_upserts_and_resumed_work(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(tuple(r) for r in reconcile.upserted(a, b, ["k"]).collect()) == [(1, "x"), (2, "z"), (3, "w")]
    assert [r.k for r in files.resumable(a.where("k = 1"), a, ["k"]).collect()] == [2]
    with pytest.raises(ValueError, match="another input"):
        files.resumable(b, a, ["k"])
    files.write_jsonl(a, f"{tmp_path}/out")
    assert files.jsonl(spark, f"{tmp_path}/out", "k int, v string", strict=True, required=["k", "v"]).count() == 2


def test_vectors_by_key(spark):
    chunks = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, ord int")
    vectors = spark.createDataFrame([("d", 2, [1.0]), ("e", 1, [2.0])], "doc string, ord int, v array<double>")
    assert sorted((r.ord, r.v) for r in files.keyed_vectors(vectors, chunks, ["doc", "ord"]).collect()) == [(1, None), (2, [1.0])]
    with pytest.raises(ValueError):
        files.keyed_vectors(vectors.union(vectors), chunks, ["doc", "ord"]).collect()


def test_support_without_unchecked_sums(spark):
    claims = ['{"tipo": "andamiaje", "texto": "El numero de equipos utiles en la subred es 64 - 2 = 62 equipos."}', '{"tipo": "conocimiento", "texto": "la suma fabricada 64 - 2 = 62"}', '{"tipo": "literal", "texto": "clave", "cita": "primaria única"}', '{"tipo": "andamiaje", "texto": "sesenta equipos"}', "[no"]
    got = value(spark, verify.support_of(F.array(*map(F.lit, claims))))
    assert set(got) == {"suma", "fabricada", "clave", "primaria", "única", "sesenta", "equipos"}
    assert value(spark, verify.support_of(F.array().cast("array<string>"))) == []
    frase = "En la subred caben sesenta y dos equipos utiles disponibles."
    sums, plain = (value(spark, verify.sentence_backing(F.lit(frase), verify.support_of(F.array(F.lit(c))))) for c in (claims[0], claims[0].replace("64 - 2 = 62", "sesenta y dos")))
    assert (sums, plain) == ("unbacked", "backed")


def test_detection_set(spark):
    divergent = spark.createDataFrame([("0485", "clave ajena", ["a", "b"])], "code string, term string, documents array<string>")
    rows = [("java", "0485", "paso", "¿Se pasan?", f"d{i % 8}") for i in range(20)]
    planted = spark.createDataFrame(rows, "id string, code string, term string, question string, document string")
    missed = spark.createDataFrame([("mvc", "0613", "vista", "¿Qué es la Vista?", "x")], planted.schema)
    got = {r.id: (r.origin, r.expected, r.documents, r.detected, r.question) for r in checks.detection_set(divergent, planted, missed).collect()}
    assert got == {
        "glosario-0485-clave_ajena": ("glosario", "aviso_de_definiciones_divergentes", ["a", "b"], True, "¿Qué es clave ajena?"),
        "plantado-java": ("plantado", "aviso_de_conflicto_con_las_dos_versiones", [f"d{i}" for i in range(6)], True, "¿Se pasan?"),
        "conocido-mvc": ("conocido", "aviso_de_conflicto_con_las_dos_versiones", ["x"], False, "¿Qué es la Vista?"),
    }


def test_glossary_for_many_questions(spark):
    rows = [(1, "Clave ajena", 10), (1, "clave", 11), (1, "clave ajena", 12), (2, "clave", 13), (1, "ajena clave", 14), (1, None, 15)]
    glossary = spark.createDataFrame(rows, "subject_id int, term string, chunk_id int")
    asked = spark.createDataFrame([(1, "¿Qué es una  CLAVE ajena ?"), (2, "la clave, sí"), (3, None), (4, "clave")], "query_id int, question string")
    scope = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (4, 2)], "query_id int, subject_id int")
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in retrieval.by_glossary_all(glossary, asked, scope, 3).collect())
    assert got == [(1, 1, 10), (1, 2, 12), (1, 3, 11), (4, 1, 11), (4, 2, 13)]


def test_whole_retrieval(spark):
    from lantern.operators import lexical

    rows = [(i, 1 + i % 3, f"{'clave' if i % 3 else 'tabla'} texto {i}", [1.0, i / 10]) for i in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_id int, subject_id int, text string, embedding array<double>")
    subjects = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (3, 1, 9), (4, 2, 0)], "subject_id int, degree_id int, chunks int")
    index = lexical.postings(chunks, "chunk_id", keep=["subject_id"])
    asked = [(1, "clave", 1, 1, None), (2, "tabla", 1, None, None), (3, "nada", 1, 2, None), (4, "clave", 2, None, None), (5, None, 1, 3, [1.0, 0.0]), (6, "x", 9, None, None)]
    questions = spark.createDataFrame(asked, "query_id int, question string, degree_id int, subject_id int, v array<double>")
    glossary = spark.createDataFrame([(2, "clave", 4)], "subject_id int, term string, chunk_id int")
    got = {}
    for r in retrieval.retrieve_all(chunks, index, questions, subjects, glossary, k=3).collect():
        got.setdefault(r.query_id, []).append(r)
    one = {q: (rs[0].first_subject, rs[0].level, rs[0].adopted, sorted((x["rank"], x.chunk_id) for x in rs if x.chunk_id is not None)) for q, rs in got.items()}
    assert one[1][:3] == (1, "low", True) and one[1][3][0] == (1, 4)  # nothing in subject 1: the others are searched, glossary too
    assert one[2] == (1, "low", False, [(1, 0), (2, 3), (3, 6)])  # no subject asked: the richest, ties to the smaller id
    assert one[3] == (2, "low", False, []) and one[4] == (None, "low", False, []) and one[6] == (None, "low", False, [])
    assert one[5][0] == 3 and [c for _, c in one[5][3]] == [2, 5, 8] and not one[5][2]


@pytest.mark.parametrize("kind", ["runs", "one", "mixed", "two"])
def test_negative_pairs_by_trying_all_places(spark, kind):
    import random

    r = random.Random(kind)
    n = 150
    doc = {"runs": [i // 40 for i in range(n)], "one": [1] * n, "mixed": [r.choice([0, 0, 0, 0, 1, 2, None]) for _ in range(n)], "two": [0] * (n - 1) + [1]}[kind]
    ids = sorted(r.sample(range(1000), n))
    linked = {tuple(sorted(r.sample(ids, 2))) for _ in range(1500)}
    df = spark.createDataFrame(list(zip(ids, doc, strict=True)), "id int, d int").repartition(3)
    ties = spark.createDataFrame([(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(sorted(linked))], "a int, b int")
    for known in (None, linked):
        want = {}
        for i, a in enumerate(ids):
            for k in range(n):
                j = (i * 7 + k) % n
                if doc[j] != doc[i] and (known is None or tuple(sorted((a, ids[j]))) not in known):
                    want[a] = ids[j]
                    break
        got = evidence.negative_pairs(df, "id", "d", None if known is None else ties).collect()
        assert len(got) == len(want) and {x.a: x.b for x in got} == want


def test_run_ends(spark):
    groups = ["a", "a", "b", None, None, "a", "a"]
    df = spark.createDataFrame(list(enumerate(groups)), "i int, g string").repartition(2)
    for block in (1, 2, 100):
        got = {r.i: r.next for r in evidence.run_ends(df, "i", "g", block).collect()}
        assert got == {0: 2, 1: 2, 2: 3, 3: 5, 4: 5, 5: 9, 6: 9}
    assert evidence.run_ends(df.where("i < 2"), "i", "g").where("next is not null").count() == 0


def test_first_differences(spark):
    cases = [("abc", "abd", (2, "abc", "abd")), ("ab", "abcd", (2, "ab", "abcd")), ("", "x", (0, "", "x")), ("a", "a", None), (None, "a", None), ("x" * 100 + "1" + "y" * 100, "x" * 100 + "2" + "z" * 9, (100, "x" * 40 + "1" + "y" * 39, "x" * 40 + "2" + "z" * 9))]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").select("i", X.difference(F.col("a"), F.col("b")).alias("d")).collect()
    assert {r.i: None if r.d is None else tuple(r.d) for r in got} == {i: w for i, (*_, w) in enumerate(cases)}


def test_manifests(spark):
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    disk = spark.createDataFrame([("a", "9"), ("b", "8"), ("d", "4"), ("d", "4")], "path string, sha256 string")
    assert sorted(map(tuple, lookups.manifest_append(manifest, disk).collect())) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]
    named = spark.createDataFrame([("b",), ("c",)], "path string")
    assert sorted((r.path, r.sha256, r.changed) for r in lookups.manifest_rehash(manifest, named, disk).collect()) == [("a", "1", False), ("b", "8", True), ("c", "3", False)]
    assert sorted(r.path for r in lookups.manifest_delist(manifest, named.where("path = 'c'"), disk).collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="still on disk: b"):
        lookups.manifest_delist(manifest, named, disk)
    for act in (lookups.manifest_rehash, lookups.manifest_delist):
        with pytest.raises(ValueError, match="not in the manifest: z"):
            act(manifest, spark.createDataFrame([("z",)], "path string"), disk)
    assert {r.path for r in lookups.unlisted(disk, manifest).collect()} == {"d"}


def test_loads_count_what_is_left_out_and_refuse_what_lacks(spark):
    chunks = spark.createDataFrame([(i,) for i in range(6)], "k int")
    out = spark.createDataFrame([(0, "dump"), (1, "dump"), (2, "secret")], "k int, reason string")
    vectors = spark.createDataFrame([(i, [float(i)]) for i in (3, 4, 5)], "k int, v array<double>")
    rows, counts = lookups.loadable(chunks, out, {"vector": vectors}, ["k"])
    assert sorted(r.k for r in rows.collect()) == [3, 4, 5] and {tuple(r) for r in counts.collect()} == {("dump", 2), ("secret", 1)}
    with pytest.raises(ValueError, match=r"no vector of \(4,\)"):
        lookups.loadable(chunks, out, {"vector": vectors.where("k <> 4")}, ["k"])


def test_conflicting_definitions(spark):
    rows = [(1, "a", "X", "d1"), (1, "a", "x", "d2"), (1, "b", "X", "d1"), (1, "b", "Y", "d1"), (1, "c", "X", "d1"), (1, "c", "Y", "d2"), (2, "c", "X", "d1")]
    p = spark.createDataFrame(rows, "subject_id int, term string, definition string, path string")
    assert {r.term for r in lookups.definition_conflicts(p).collect()} == {"c"} and {r.term for r in lookups.definition_conflicts(p, raw=True).collect()} == {"a", "b", "c"}


def test_the_context_line_is_inside_the_budget(spark):
    text = "\n\n".join(" ".join(f"palabra{i} punto." for i in range(40)) for _ in range(6))
    line = "DAW · curso 1 · programacion · Unidad 4 · " + "título largo " * 10
    df = spark.createDataFrame([(1, text, line), (2, text, None), (3, None, line), (4, text, "x " * 900)], "doc int, body string, line string")
    got = ingest.chunk(df, "doc", "body", 120, 20, "line").collect()
    for r in got:
        assert r.n_tokens + min(ingest._tokens(r.context or "") + 2, 60) <= 120 and ingest._tokens(r.text) == r.n_tokens
    many = {d: sum(r.doc == d for r in got) for d in (1, 2, 3, 4)}
    assert many[1] > many[2] > 0 == many[3] and many[4] >= many[1]
    plain = ingest.chunk(df.where("doc = 2"), "doc", "body", 120, 20).collect()
    assert max(r.n_tokens for r in plain) > max(r.n_tokens for r in got if r.doc == 1)
