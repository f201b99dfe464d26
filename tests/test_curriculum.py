"""Sections of a curriculum's text, their audits, and the articles that they are checked against."""

from pyspark.sql import functions as F

from lantern.functions import curriculum as C

FIRST = """Módulo Profesional: Sistemas de gestión de
información.
Equivalencia en créditos ECTS: 7
Código: 0373
Resultados de aprendizaje y criterios de evaluación.
1. Reconoce las características de lenguajes de marcas
analizando sus reglas. Criterios de evaluación:
a) Se han visto.
2. Genera interfaces Web correctas. Criterios de evaluación:
la sindicación de
contenidos.
Contenidos básicos:
Reconocimiento de las características y
protección ambiental:
− Clasificación.
− VLAN. Etiquetado IEEE802.1Q.
Configuración y administración de protocolos:
- OSPF.
Otra cosa que cierra igual:
sin viñeta
\fOrientaciones pedagógicas.
La función incluye aspectos como:
− Nada.
"""
SECOND = "\fMódulo profesional: Proyecto. \nCódigo: 0612\nContenidos\nnada con viñetas\n"
TEXT = "Artículo primero. Uno.\nArtículo segundo. DAM:\n0483. Sistemas informáticos.\n0484 Bases de Datos y\n otras cosas.\n0483 Repetido en la lista\nArticulo tercero. DAW\nANEXO I\n0999 Fuera de la lista\n" + FIRST + SECOND


def test_sections():
    rows = list(C.sections(TEXT))
    assert [(c, k, n, name, page) for c, k, n, name, page, _, _ in rows] == [
        ("0373", "module", 0, "Sistemas de gestión de información", 1),
        ("0373", "outcome", 0, "Reconoce las características de lenguajes de marcas analizando sus reglas", 1),
        ("0373", "outcome", 1, "Genera interfaces Web correctas", 1),
        ("0373", "unit", 0, "Reconocimiento de las características y protección ambiental", 1),
        ("0373", "unit", 1, "Configuración y administración de protocolos", 1),
        ("0373", "loose", 0, "Otra cosa que cierra igual", 1),
        ("0612", "module", 0, "Proyecto", 3),
        ("0612", "mute", 0, "Proyecto", 3),
    ]
    for _, k, _, name, _, b, e in rows:
        if k in ("outcome", "unit", "loose"):
            assert C._clean(TEXT[b:e]) == name
    assert rows[0][6] == rows[-2][5] and list(C.sections("")) == []
    order = "Módulo Profesional: Redes\nCódigo: 0370\nContenidos:\na) Caracterización de redes:\n1. Uno\nb) Integración de\n elementos:\n- Dos\n"
    assert [r[3] for r in C.sections(order, "order") if r[1] == "unit"] == ["Caracterización de redes", "Integración de elementos"]


def test_table_function(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "nada"), (4, FIRST)], "doc long, body string")
    got = C.sections_of(df, "doc", "body")
    assert {(r.doc, r.code, r.level) for r in got.where("level = 'module'").collect()} == {(1, "0373", "module"), (1, "0612", "module"), (4, "0373", "module")}
    C.table_function(spark)
    df.createOrReplaceTempView("bodies")
    assert spark.sql("SELECT doc, s.name FROM bodies, LATERAL curriculum_sections(body, 'decree') s WHERE s.level = 'unit'").count() == 4


def test_articles(spark):
    one = spark.createDataFrame([(TEXT,)], "t string")
    value = lambda c: one.select(c).first()[0]
    a = value(C.article(F.col("t"), "segundo"))
    assert a["text"].startswith("Artículo segundo. DAM") and a["text"].endswith("lista\n") and TEXT[a["begin"] : a["end"]] == a["text"]
    assert value(C.article(F.col("t"), "tercero"))["end"] == len(TEXT) and value(C.article(F.lit("x"), "primero")) is None
    assert value(C.listed_codes(F.col("t"))) == ["0483", "0484"]
    assert value(C.listed_names(F.col("t"))) == {"0483": "sistemas informaticos", "0484": "bases de datos y otras cosas"}
