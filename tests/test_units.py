"""Golden values and laws of single operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lantern.functions import calc
from lantern.functions import text as X
from lantern.operators import evidence, ingest, metrics, quality, reconcile, retrieval, verify
from lantern.sources import files
from lantern.streaming import tokens


@pytest.mark.parametrize(
    "expression,result,verdict",
    [
        ("2+2", "4", "verificada"), ("(255-192)+1", "64", "verificada"), ("2**32", "4294967296", "verificada"), ("binomial(7,2)", "21", "verificada"),
        ("factorial(20)", "2432902008176640000", "verificada"), ("sqrt(16)", "4", "verificada"), ("2+2", "5", "podada"), ("10/3", "3,5", "podada"),
        ("2**32", "4294967295", "podada"), ("x + 1", "3", "no_verificable"), ("2 == 2", "1", "no_verificable"), ("lambda: 1", "1", "no_verificable"),
        ("2/3", "0,7", "verificada"), ("2/3", "0,67", "verificada"), ("2/3", "0,70", "podada"), ("1/8", "0,13", "verificada"), ("1/8", "0,12", "podada"),
        ("50*1,21", "61", "verificada"), ("50*1,21", "60,5", "verificada"), ("50*1,21", "60", "podada"), ("2**32", "4.294967296", "no_verificable"),
        ("2**60+1", "1152921504606846977", "verificada"), ("2**60+1", "1152921504606846976", "podada"), ("9**9**9", "1", "no_verificable"), ("1/0", "1", "no_verificable"),
    ],
)
def test_calc(expression, result, verdict):
    assert calc.verdict(expression, result)[0] == verdict


@given(st.fractions(max_denominator=50).filter(lambda f: abs(f) < 1000), st.fractions(max_denominator=50).filter(lambda f: abs(f) < 1000))
@settings(max_examples=50, deadline=None)
def test_calc_is_exact(a, b):
    s = a + b
    e = f"({a.numerator}/{a.denominator})+({b.numerator}/{b.denominator})"
    if s.denominator == 1:
        assert calc.verdict(e, str(s.numerator))[0] == "verificada"
        assert calc.verdict(e, str(s.numerator + 1))[0] == "podada"


ANSWER = r'{"modo": "x", "otra": {"prosa": "no", "l": ["prosa", {"a": "}"}]}, "clave": "prosa", "prosa": "Hola \"tú\" 😀\n\\ fin", "n": 3}'


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 100000])
def test_prose_does_not_depend_on_the_cut(size):
    p, out = tokens.Prose("prosa"), ""
    for i in range(0, len(ANSWER), size):
        p = tokens.Prose("prosa", p.state())
        out += p.feed(ANSWER[i : i + size])
    assert out == 'Hola "tú" 😀\n\\ fin'


def test_early_array():
    text = '{"a": "[x]", "claims": [{"t": "]"}, [1]], "prosa": "'
    assert tokens.early_array(text, "claims") == '[{"t": "]"}, [1]]'
    assert tokens.early_array(text[:30], "claims") is None


@given(st.text(alphabet="ab .!?\n", max_size=60), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_gate_loses_nothing(text, size):
    g, out = tokens.Gate(), []
    for i in range(0, len(text), size):
        out += g.feed(text[i : i + size])
    assert "".join(out + g.close()) == text


def test_rate_watchdog():
    assert tokens.cut_at([i / 105 for i in range(600)]) is None
    assert tokens.cut_at([i / 38 for i in range(300)]) is None
    assert tokens.cut_at([i / 11 for i in range(100)]) is not None
    assert tokens.cut_at([i / 11 for i in range(8)]) is None
    assert tokens.rates([0.0, 0.5])[1] is None


def test_streams(spark, tmp_path):
    """What waits is given out when a response ends, and not before."""
    rows = [(r, i, ANSWER[i * 5 : i * 5 + 5]) for r in (1, 2) for i in range(-(-len(ANSWER) // 5))] + [(1, 1000, None)]
    spark.createDataFrame(rows, "response_id long, seq long, text string").write.parquet(f"{tmp_path}/prose")
    said = "Uno. Dos va\nTres sin fin"
    rows = [(r, i, said[i * 4 : i * 4 + 4]) for r in (1, 2) for i in range(-(-len(said) // 4))] + [(1, 1000, None)]
    spark.createDataFrame(rows, "response_id long, seq long, text string").write.parquet(f"{tmp_path}/gate")
    out = {}
    for name, f, column in (("prose", tokens.prose_stream, "prose"), ("gate", tokens.gate_stream, "sentence")):
        stream = f(spark.readStream.schema("response_id long, seq long, text string").parquet(f"{tmp_path}/{name}"))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c-{name}").start()
        assert q.awaitTermination(60)
        for i in (1, 2):
            out[name, i] = [r[column] for r in spark.sql(f"SELECT * FROM {name} WHERE response_id = {i}").collect()]
    assert "".join(out["prose", 1]) == "".join(out["prose", 2]) == 'Hola "tú" 😀\n\\ fin'
    assert "".join(out["gate", 1]) == said and len(out["gate", 1]) == 3
    assert "".join(out["gate", 2]) == "Uno. Dos va\n"


def test_gain_and_levels(spark):
    df = spark.createDataFrame([(None,), (6,), (1,), (3,)], "p int")
    assert [r[0] for r in df.select(metrics.gain(F.col("p"))).collect()] == [0.0, 0.0, 1.0, 0.5]
    df = spark.createDataFrame([(0.085, 0.664), (0.085, 0.6), (0.025, 0.9), (0.02, 0.9), (None, None)], "m double, b double")
    assert [r[0] for r in df.select(retrieval.level(F.col("m"), F.col("b"))).collect()] == ["high", "medium", "medium", "low", "low"]


def test_subject_is_needed(spark):
    df = spark.createDataFrame([(1, 2)], "chunk_id long, subject_id int")
    for bad in ([], None):
        with pytest.raises(ValueError):
            retrieval.in_subjects(df, bad)
    assert retrieval.in_subjects(df, 2).count() == 1


def test_fusion(spark):
    rows = [(1, "vector", 10, 1), (1, "lexical", 10, 3), (1, "lexical", 11, 1), (1, "glossary", 9, 1)]
    got = retrieval.fuse(spark.createDataFrame(rows, "query_id int, list string, chunk_id int, rank int"), 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.origins) for r in got] == [(10, "lexical#3+vector#1"), (9, "glossary#1"), (11, "lexical#1")]
    assert abs(got[0].score - (10 / 61 + 1 / 63)) < 1e-9


def test_glossary_and_rerank(spark):
    g = spark.createDataFrame([("clave", 1), ("clave primaria", 2), ("indice", 3)], "term string, chunk_id int")
    assert [r.chunk_id for r in retrieval.by_glossary(g, "que es una clave primaria aqui", 3).collect()] == [2, 1]
    assert retrieval.by_glossary(g, "clave primaria?", 3).count() == 1  # the sign is glued to the word
    df = spark.createDataFrame([(1, 1, 0.9, 0.1, 5), (1, 2, 0.8, 0.7, 6)], "query_id int, rank int, score double, s double, chunk_id int")
    assert [(r.chunk_id, r.rank) for r in retrieval.rerank(df, "s").orderBy("rank").collect()] == [(6, 1), (5, 2)]


def test_text_levels(spark):
    df = spark.createDataFrame([("La  «clave»\nprimaria es ésta…", 1)], "t string, n int")
    held = lambda n, level: df.select(X.holds(F.col("t"), F.lit(n), level)).first()[0]
    assert not held("La «clave» primaria", "exact") and held("La «clave» primaria", "spaces")
    assert held('"clave" primaria es ésta...', "typography") and not held("esta", "lower") and held("ÉSTA", "lower")
    assert df.select(X.strip_accents(F.lit("Ñandú ÀÈ"))).first()[0] == "Nandu AE"


@pytest.mark.parametrize(
    "turn,mode",
    [
        ("Mi código da error, ¿qué falla?", "corregir"), ("He hecho esto: SELECT 1", "corregir"), ("Ayúdame con el ejercicio, aún no lo he hecho", "acompanar"),
        ("¿Cómo se calcula una subred? Es para el ejercicio 5", "responder"), ("ponme un test", "responder"), ("¿Qué es una clave primaria?", "responder"),
        ("tengo que montar una red y no sé por dónde empezar", "acompanar"), ("explícame cómo lo haría un profesional y luego te enseño lo mío", "responder"),
        ("Mira mi código, y luego te paso el siguiente ejercicio.", "corregir"), ("No entiendo que me pide", "acompanar"), ("quiero hacer el de las subredes", "acompanar"), ("Tómame la lección", "responder"),
    ],
)
def test_turns(spark, turn, mode):
    assert spark.range(1).select(X.turn_mode(F.lit(turn))).first()[0] == mode


def test_verdicts(spark):
    row = spark.createDataFrame([("la clave es única", "la clave es única aquí", 5, [5]), ("la clave es unica", "la clave es única aquí", 5, [5]), ("la llave es única", "la clave es única", 5, [5]), ("la clave", "la clave", 6, [5])], "q string, c string, i int, ctx array<int>")
    got = [r[0] for r in row.select(verify.literal_verdict(F.col("q"), F.col("c"), F.col("i"), F.col("ctx"))).collect()]
    assert got == ["verificada", "degradada_a_parafrasis", "degradada_a_parafrasis", "podada"]
    assert [r[0] for r in row.select(verify.only_accents(F.col("q"), F.col("c"))).collect()] == [True, True, False, True]
    blank = spark.createDataFrame([("  ", "x", 5, [5]), (None, "x", 5, [5])], "q string, c string, i int, ctx array<int>")
    for r in blank.select(verify.literal_verdict(*map(F.col, ("q", "c", "i", "ctx"))).alias("v"), verify.literal_reason(*map(F.col, ("q", "c", "i", "ctx"))).alias("w")).collect():
        assert tuple(r) == ("degradada_a_parafrasis", "sin_cita")
    rows = [("entailment", 0.9, 0.5, False), ("entailment", 0.89, 0.5, False), ("contradiction", 0.1, 0.5, False), ("entailment", 0.99, 0.2, False), ("entailment", 0.99, 0.9, True)]
    df = spark.createDataFrame(rows, "l string, p double, c double, k boolean")
    assert [r[0] for r in df.select(verify.entailment_verdict(*map(F.col, "lpck"))).collect()] == ["verificada", "reintento", "podada", "no_verificable", "no_verificable"]


def test_two_units(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "n int, k string")
    assert metrics.two_units(df, ["k"]).first() == (4, 2, 2.0)
    assert metrics.two_units(df.limit(0), ["k"]).first() == (0, 0, 0.0)
    with pytest.raises(ValueError):
        metrics.two_units(df, [" "])
    assert [r.n for r in metrics.first_of(df, ["k"], "n").orderBy("n").collect()] == [1, 3]


def test_pairs_meet_once_across_blocks(spark):
    rows = [(i, 1, [1.0, i / 100, 0.0]) for i in range(25)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    one = {tuple(r) for r in quality.similar_pairs(df, 0.99, "id", "v", "g").collect()}
    many = quality.similar_pairs(df, 0.99, "id", "v", "g", block=4).collect()
    assert len(many) == len(one) == len({(r.a, r.b) for r in many}) and {tuple(r) for r in many} == one
    a = {tuple(r) for r in quality.nearest_outside(df.withColumn("g", F.col("id") % 3), "id", "v", "g").collect()}
    assert a == {tuple(r) for r in quality.nearest_outside(df.withColumn("g", F.col("id") % 3), "id", "v", "g", block=4).collect()}


def test_neighbouring_chunks_are_no_copies(spark):
    df = spark.createDataFrame([(1, 1, 7, 0, [1.0, 0.0]), (2, 1, 7, 1, [1.0, 0.0]), (3, 1, 7, 5, [1.0, 0.0])], "id long, g int, d long, o int, v array<double>")
    assert {(r.a, r.b) for r in quality.similar_pairs(df, 0.95, "id", "v", "g", "o", "d").collect()} == {(1, 3), (2, 3)}


@given(st.lists(st.sampled_from(["uno", "dos.", "tres", "\n\n", "cuatro!", "# T\n", "x" * 30]), max_size=80), st.integers(12, 40))
@settings(max_examples=60, deadline=None)
def test_chunks_keep_the_budget(parts, budget):
    for c in ingest.split(" ".join(parts), budget, 4):
        assert c[3] <= budget and c[5].strip()


def test_reconcile(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, h string")
    b = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, h string")
    assert dict(reconcile.compare(a, b, "path", "h").collect()) == {"a": "left_only", "b": "same", "c": "changed", "d": "right_only"}
    with pytest.raises(ValueError):
        reconcile.require_unique(a.union(a), ["path"])
    assert reconcile.insert_new(a, b.union(b), ["path"]).count() == 1
    assert reconcile.overridden([a, b], ["path"], ["h"]).where("path = 'c'").first().h == "9"


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": \n')
    assert files.jsonl(spark, f"{tmp_path}/a.jsonl", "x int", strict=True, required=["x"]).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        files.jsonl(spark, f"{tmp_path}/b.jsonl", "x int", strict=True).collect()
    assert files.inventory(spark, str(tmp_path), "*.jsonl").count() == 2
    rows = spark.createDataFrame([(1, 1, "event: token"), (1, 2, "data: a"), (1, 3, "data: b"), (1, 4, ""), (1, 5, "data: x")], "stream_id int, n int, line string")
    assert [(r.event, r.data) for r in files.server_events(rows).orderBy("seq").collect()] == [("token", "a\nb"), ("message", "x")]
    new = spark.createDataFrame([(1, "a")], "k int, v string")
    files.append_new(spark, new, f"{tmp_path}/t", ["k"])
    files.append_new(spark, new.union(spark.createDataFrame([(2, "b")], "k int, v string")), f"{tmp_path}/t", ["k"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_chunk_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, [1.0]), (2, 8, None)], "chunk_id long, subject_id int, embedding array<float>")
    with pytest.raises(ValueError):
        files.write_chunks(rows, f"{tmp_path}/c")
    files.write_chunks(rows.where("chunk_id = 1"), f"{tmp_path}/c")
    files.replace_scope(spark.createDataFrame([(3, 8, [1.0])], "chunk_id long, subject_id int, embedding array<float>").select("chunk_id", "embedding", "subject_id"), f"{tmp_path}/c", ["subject_id"])
    assert spark.read.parquet(f"{tmp_path}/c").count() == 2
    plan = retrieval.in_subjects(spark.read.parquet(f"{tmp_path}/c"), 7)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(subject_id" in plan or "PartitionFilters: [subject_id" in plan


def test_gates(spark):
    long = " ".join(["palabra"] * 50)
    rows = [("403 Forbidden", "directory page"), (long, "no prose"), ("Esto es una frase bastante larga que acaba en punto. " * 5, None), ("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVox2345", "dump of long tokens"), ("", "dump of long tokens")]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(X.chunk_verdict(F.col("t"))).collect()
    assert [r[0] for r in got] == [w for _, w in rows]


def test_premises():
    text = "Una clave identifica una fila. Esta clave es única. " + "Otra frase larga que sigue a lo dicho. " * 20
    assert evidence.locate(text, "CLAVE  es unica") == (text.index("clave es única"), text.index("clave es única") + 14)
    window, route = evidence.premise(text, "clave es única", "la clave es única")
    assert "clave es única" in window and len(window) <= evidence.WIDE and route in ("window", "widened")
    assert evidence.premise(text, "no está", "una clave identifica filas")[1] == "sentence"
    assert evidence.premise("", "x", "y") == (None, "none")


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert str(value(evidence.pdf_date(F.lit("D:20240131120000")))) == "2024-01-31" and value(evidence.pdf_date(F.lit("x"))) is None
    assert [value(evidence.retry_after(F.lit(s))) for s in ("2", "1.5s", "250ms", "1m", "soon", "", "-3", "1m30s", "0ms")] == [2.0, 1.5, 0.25, 4.0, None, None, 0.0, 4.0, 0.0]
    now = F.to_timestamp(F.lit("2026-08-13 10:00:00"))
    assert [value(evidence.retry_after(F.lit(s), now)) for s in ("Thu, 13 Aug 2026 10:00:03 GMT", "Thu, 13 Aug 2026 09:00:00 GMT", "Thu, 13 Aug 2026 11:00:00 GMT", "Thu, 99 Aug 2026 10:00:03 GMT")] == [3.0, 0.0, 4.0, None]
    resets = [F.lit("100ms"), F.lit("2s"), F.lit("never")]
    assert [value(evidence.retry_after(F.lit(s), resets=resets)) for s in ("", None, "1", "soon")] == [2.0, 2.0, 1.0, None]
    assert value(X.national_letter(F.lit(12345678))) == "Z" and value(X.reference_number(F.lit("F123"))) == 123 and value(X.reference_number(F.lit("G1"))) is None
    assert value(X.first_difference(F.lit("abc"), F.lit("abd"))) == 3 and value(X.first_difference(F.lit("a"), F.lit("a"))) is None
    assert value(evidence.next_pass(F.lit(1), F.lit(0), F.lit(False), F.lit(10))) == "retry" and value(evidence.next_pass(F.lit(1), F.lit(5), F.lit(False), F.lit(10))) == "stop"
    assert value(verify.abstains(F.lit(True), F.lit(10), F.lit(" \u00a0\n"))) == "empty"
