"""The query language, the analyser and the ranks of lexical search."""

import random
import re

import pytest

from lantern.functions.stems import stem
from lantern.operators import lexical


@pytest.mark.parametrize(
    "question,tree",
    [
        ("clave primaria", [["clave", "primaria"]]),
        ('"clave primaria" or foránea -sql', [["clave primaria"], ["foránea", "-sql"]]),
        ("clave OR Foránea", [["clave"], ["foránea"]]),
        ('"clave de la tabla"', [["clave · · tabla"]]),
        ('"clave sin cerrar', [["clave · cerrar"]]),
        ('-"clave primaria" tabla', [["-clave primaria", "tabla"]]),
        ("pro-cliente - x", [["pro", "cliente", "x"]]),
        ('"or" uno', [["or"]]),
        ("or or x or", [["x"]]),
        ("-solo", []),
        ("de la que", []),
        ('"de la" tabla', [["tabla"]]),
        ("x x -x", [["x", "-x"]]),
        ("", []),
    ],
)
def test_questions(question, tree):
    def shown(unit):
        excluded, terms = unit
        words = ["·"] * (terms[-1][0] + 1)
        for i, t in terms:
            words[i] = t
        return "-" * excluded + " ".join(words)

    assert [[shown(u) for u in alternative] for alternative in lexical.query_tree(question, stemmed=False)] == tree


def test_stop_words():
    assert len(lexical.STOP_WORDS) == len(set(lexical.STOP_WORDS)) == 313
    for w in "fue tiene había estuviésemos hubieran fuésemos seáis tened habéis nuestras".split():
        assert w in lexical.STOP_WORDS
    assert not {"clave", "tabla", "teniente", "ser", "haber"} & set(lexical.STOP_WORDS)


@pytest.mark.parametrize("word,lexeme", [("servidores", "servidor"), ("sesiones", "sesion"), ("rápidamente", "rapid"), ("comprándolo", "compr"), ("actualizaciones", "actualiz"), ("bibliotecas", "bibliotec"), ("niñas", "niñ"), ("lógica", "logic")])
def test_lexemes(word, lexeme):
    assert stem(word) == lexeme


def brute(texts, question, every):
    """Scores by trying every stretch of a text."""
    out = {}
    for i, text in texts.items():
        words = re.findall(r"\w+", (text or "").lower())
        found = []
        for alternative in lexical.query_tree(question, stemmed=False):

            def places(terms):
                return [(s, s + terms[-1][0]) for s in range(len(words)) if all(s + o < len(words) and words[s + o] == t for o, t in terms)]

            units = [(x, terms, places(terms)) for x, terms in alternative]
            if any(p for x, _, p in units if x):
                continue
            found.append([(terms, p) for x, terms, p in units if not x])
        if not every:
            score = 0.1 * sum(len(p) for p in {t: p for a in found for t, p in a}.values())
        else:
            score = 0
            for a in found:
                if not all(p for _, p in a):
                    continue
                all_places = [(s, e, len(t)) for t, p in a for s, e in p]
                holds = lambda s, e: all(any(s <= x and y <= e for x, y in p) for _, p in a)  # noqa: B023, E731
                fits = {(s, e) for s, _, _ in all_places for _, e, _ in all_places if s <= e and holds(s, e)}
                for s, e in fits:
                    if not any(s <= x and y <= e and (x, y) != (s, e) for x, y in fits):
                        own = sum(n for x, y, n in all_places if s <= x and y <= e)
                        score += 0.1 / (1 + max(0, e - s + 1 - own))
        if score:
            out[i] = round(score, 5)
    return out


QUESTIONS = ["x y", '"x y"', '"x y" or z -w', 'x -"y z"', '"x y" "y z"', "x y z w", '"x de y" z or w', "x x", "x or x y", "-x", '"z z" z', "nada", "de", None]


@pytest.mark.parametrize("every", [False, True])
def test_search_by_brute_force(spark, every, tmp_path):
    r = random.Random(3)
    texts = {i: " ".join(r.choice(["x", "y", "z", "w", "de", "v", "v", "u"]) for _ in range(r.randint(0, 24))) for i in range(120)}
    texts |= {200: None, 201: "", 202: "de la que", 203: "x, y. Z-w", 204: "x y " * 200}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id int, text string")
    index = lexical.postings(chunks, "chunk_id", stemmed=False)
    lexical.write_postings(index, f"{tmp_path}/index")
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, question string")
    for stored in (index, spark.read.parquet(f"{tmp_path}/index")):
        got = lexical.search_all(stored, questions, 1000, "chunk_id", every=every, stemmed=False).collect()
        for i, q in enumerate(QUESTIONS):
            mine = {g["chunk_id"]: round(g["score"], 5) for g in got if g["query_id"] == i}
            assert mine == pytest.approx(brute(texts, q or "", every), abs=2e-5), (q, every)
            assert sorted(g["rank"] for g in got if g["query_id"] == i) == list(range(1, len(mine) + 1))


def test_search_within_a_scope(spark):
    chunks = spark.createDataFrame([(1, 1, "una tabla"), (2, 2, "dos tablas"), (3, 2, "otra tabla con tablas")], "chunk_id int, subject_id int, text string")
    index = lexical.postings(chunks, "chunk_id", keep=["subject_id"])
    questions = spark.createDataFrame([(7, "tablas"), (8, "tabla"), (9, "tabla")], "query_id int, question string")
    scope = spark.createDataFrame([(7, 2), (8, 1), (9, 1), (9, 2)], "query_id int, subject_id int")
    got = lexical.search_all(index, questions, 5, "chunk_id", scope=scope).collect()
    assert sorted((g.query_id, g.chunk_id, g["rank"]) for g in got) == [(7, 2, 2), (7, 3, 1), (8, 1, 1), (9, 1, 2), (9, 2, 3), (9, 3, 1)]
    assert "Exchange" not in index._jdf.queryExecution().toString()  # postings are made where texts are read


def test_only_the_terms_that_are_asked_for(spark):
    chunks = spark.createDataFrame([(1, "la tabla tiene claves y más claves")], "chunk_id int, text string")
    rows = lexical.postings(chunks, "chunk_id", only=lexical.terms_of("clave foránea")).collect()
    assert [(r.term, r.positions, r.n_terms) for r in rows] == [("clav", [4, 7], 7)]


def test_postings_take_few_words_at_once(spark, monkeypatch):
    """However few words are looked at together, and whichever terms are wanted, postings are the same; a question's terms are
    enough for it. Null and empty texts have none."""
    rows = [(i, t) for i, t in enumerate(["pan dos, pan. DOS tres", None, "", "tres tristes tigres y dos", "de la que", "Dos_dos x2 dos"])]
    df = spark.createDataFrame(rows, "id long, text string")
    get = lambda **o: {(r.term, r.id): (r.n_terms, list(r.positions)) for r in lexical.postings(df, "id", **o).collect()}
    whole = get(stemmed=False)
    assert whole[("pan", 0)] == (5, [1, 3]) and whole[("dos", 3)] == (5, [5]) and not any(i in (1, 2, 4) for _, i in whole)
    monkeypatch.setattr(lexical, "WORDS", 2)
    assert get(stemmed=False) == whole
    assert get(stemmed=False, only=["dos", "tres"]) == {k: v for k, v in whole.items() if k[0] in ("dos", "tres")}
    asked = spark.createDataFrame([(1, "dos -pan"), (2, None)], "query_id long, question string")
    index = lexical.postings_for(df, asked, "id", stemmed=False)
    assert {r.term for r in index.collect()} == {"pan", "dos"}
    assert [(r.query_id, r.id) for r in lexical.search_all(index, asked, 5, "id", stemmed=False).collect()] == [(1, 3), (1, 5)]
