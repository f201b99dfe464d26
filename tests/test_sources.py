"""Strict scans, dates of sources and the cleaning of pages."""

import json

import pytest

from lantern.operators import dating, ingest
from lantern.sources import files

SCHEMA = "id string, pregunta string, oro struct<documento:string,orden:int>"
REQUIRED = ["id", "pregunta", "oro.documento", "oro.orden"]


def line(i, **more):
    return json.dumps({"id": f"p{i}", "pregunta": "¿qué?", "oro": {"documento": "d", "orden": i}} | more, ensure_ascii=False)


def test_strict_scans_name_the_line_and_the_file(spark, tmp_path):
    good = [line(i) for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("\n".join(good[:5] + ["", "  "] + good[5:10]) + "\n", encoding="utf-8")
    assert files.jsonl(spark, f"{tmp_path}/a.jsonl", SCHEMA, strict=True, required=REQUIRED).count() == 10
    many = good[:3000] + [""] + [line(1, oro={"documento": "d"})] + good[:7] + ['{"id": ']
    (tmp_path / "b.jsonl").write_text("\n".join(many), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits a file
    try:
        assert spark.read.text(f"{tmp_path}/b.jsonl").rdd.getNumPartitions() > 5
        with pytest.raises(files.Malformed, match=r"b\.jsonl: line 3002: without oro\.orden"):
            files.jsonl(spark, str(tmp_path), SCHEMA, strict=True, required=REQUIRED)
        with pytest.raises(files.Malformed, match=r"b\.jsonl: line 3010: malformed"):
            files.jsonl(spark, str(tmp_path), SCHEMA, strict=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    cases = {"[1]": "malformed", "7": "malformed", '{"id": ""}': "without id, pregunta, oro.documento, oro.orden", '{"id": "x", "pregunta": "y", "oro": null}': "without oro.documento, oro.orden", '{"id": {"a": 1}, "oro": 3}': "malformed"}
    for i, (text, reason) in enumerate(cases.items()):
        (tmp_path / f"c{i}.jsonl").write_text(f"\n{good[0]}\n{text}\n{text}\n", encoding="utf-8")
        with pytest.raises(files.Malformed) as e:
            files.jsonl(spark, f"{tmp_path}/c{i}.jsonl", SCHEMA, strict=True, required=REQUIRED)
        assert f"c{i}.jsonl: line 3: {reason}" in str(e.value)
    (tmp_path / "empty.jsonl").write_text("")
    assert files.jsonl(spark, f"{tmp_path}/empty.jsonl", SCHEMA, strict=True, required=REQUIRED).count() == 0


def test_dates(spark):
    rows = [
        (1, "corpus/a/RD-686-2010.pdf", "2001-01-01", None, None, None, "2010-06-12", "norma"),
        (2, "corpus/a/x.pdf", "2002-02-02", None, None, None, "2002-02-02", "metadatos_pdf"),
        (3, "corpus/a/y.txt", "2002-02-02", None, None, None, "2010-06-12", "carpeta"),  # no PDF; a tie goes to what came first
        (4, "corpus/a/deep/z.java", None, None, None, None, "2010-06-12", "carpeta"),
        (5, "corpus/a/deep/er/z.java", None, None, None, None, None, None),  # two rungs only
        (6, "corpus/familia/q.pdf", "", None, None, None, "2019-01-01", "texto"),
        (7, "corpus/derivado/familia/q.md", None, None, "corpus/b/late", None, "2019-01-01", "texto"),
        (8, "b/copy", None, None, "corpus/a/x.pdf", None, "2002-02-02", "heredada"),
        (9, "b/copy2", None, None, "", "b/copy", "2002-02-02", "heredada"),
        (10, "b/copy3", None, None, "b/copy2", "corpus/a/x.pdf", "2002-02-02", "heredada"),
        (11, "b/early", None, "1990-01-01", "b/late", None, "1991-01-01", "heredada"),  # its origin has inherited nothing yet
        (12, "b/late", None, "1991-01-01", "b/copy", None, "2002-02-02", "heredada"),
        (13, "b/lost", None, None, "nowhere", None, None, None),
        (14, "b/child", None, None, "b/lost", None, None, None),
        (15, "b/self", None, None, "b/self", None, None, None),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "n int, path string, pdf_date string, known_date string, derived_from string, planted_from string").repartition(3)
    got = dating.dated(df, [("RD-686-2010", "2010-06-12"), ("RD", "1900-01-01")], [("corpus/familia", "2019-01-01", "texto: año"), ("corpus/fam", "1", "x")])
    assert {r.n: (r.date, r.origin) for r in got.collect()} == {r[0]: r[6:] for r in rows}
    assert dating.dated(df.limit(0), [], []).count() == 0


def pages(*each):
    return "\f".join(each)


def test_cleaning_and_what_it_takes_back():
    head = "PROGRAMACIÓN / CFGS DAW"
    text = pages(*(f"{head}\nTEMA 6-{i} Página {i} I.S.O.\nContenido propio de la página {'abcdef'[i]} que nadie más tiene, largo y distinto, con bastante más texto que cuenta algo suyo. {head} pegado\nÍndice ......... {i}\n- {i} -" for i in range(6)))
    out, n, unique, undone = ingest.cleaned(text)
    assert n == 6 and undone == "nothing" and head not in out and "TEMA 6" not in out and "....." not in out and "- 3 -" not in out
    assert out.count("Contenido propio") == 6 and unique > len(out)
    numbered = pages(*(f"Ejercicio {i} de la lista que es todo lo que hay aquí" for i in range(8)))
    assert ingest.cleaned(numbered) == (numbered.replace("\f", "\n\n"), 8, len(numbered) + 7, "signatures")
    same = pages(*(["Esto es todo lo que dice cada página"] * 5))
    assert ingest.cleaned(same) == (same.replace("\f", "\n\n"), 5, 0, "all")
    two = pages(f"{head}\nuno", f"{head}\ndos")
    assert ingest.cleaned(two) == (two.replace("\f", "\n\n"), 2, len(two) + 1, "nothing")  # under three pages nothing is furniture
    assert ingest.cleaned("") == ("", 1, 0, "nothing")


def test_repeated_lines_by_place():
    # Inside a page half the pages are needed, at the border a third, for a footer with its number three.
    inside = [f"arriba{i} x\nabajo{i} x\n{'Introduzca el nombre del servidor.' if i < 4 else 'otra frase'}\nfin{chr(97 + i)} x\ncola{chr(97 + i)} x" for i in range(9)]
    same, loose = ingest.repeated_lines(inside)
    assert "Introduzca el nombre del servidor." in loose and "Introduzca el nombre del servidor." not in same
    assert "Introduzca el nombre del servidor." not in ingest.repeated_lines(inside + [f"solo{chr(97 + i)}" for i in range(3)])[1]
    border = [f"{'Capítulo uno' if i < 3 else 'Otra cosa ' + chr(97 + i)}\ncuerpo {chr(97 + i)}\nmás {chr(97 + i)}\ny más {chr(97 + i)}\nfin {chr(97 + i)}" for i in range(9)]
    assert ingest.repeated_lines(border) == ({"Capítulo uno"}, {"Capítulo uno"})
    foot = [f"a{chr(97 + i)} x\nb{chr(97 + i)} x\n{'Ana Ruiz. Tema ' + str(i) if i < 3 else 'nada ' + chr(97 + i)}\nc{chr(97 + i)} x\nd{chr(97 + i)} x" for i in range(12)]
    assert ingest.repeated_lines(foot)[0] == {"Ana Ruiz. Tema 0", "Ana Ruiz. Tema 1", "Ana Ruiz. Tema 2"}


def test_clean_documents(spark):
    same = pages(*(["Esto es todo lo que dice cada página"] * 5))
    got = ingest.clean_documents(spark.createDataFrame([(1, same), (2, None)], "doc long, body string"), "doc", "body").collect()
    assert sorted((r.doc, r.pages, r.undone) for r in got) == [(1, 5, "all"), (2, 1, "nothing")]
