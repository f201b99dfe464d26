"""Kinds of content, definitions and code by structure: golden texts."""

import pytest
from pyspark.sql import functions as F

from lantern.functions import teaching as T
from lantern.functions import text as X

DEFINITION = "La clave ajena es una columna, o un conjunto de columnas, que referencia a la clave primaria de otra tabla y obliga a que su valor exista alli. Sirve para mantener la integridad referencial entre las dos tablas relacionadas del modelo."
STEPS = "1. Instala el paquete con apt-get install jboss. 2. Edita el fichero de configuracion standalone.xml. 3. Arranca el servicio con systemctl start jboss. El servidor es un proceso que queda escuchando en el puerto 8080 de la maquina."
QUESTION = "Pregunta 3. ¿Cual de las siguientes afirmaciones es una definicion correcta de clave ajena? ¿Y de clave primaria? Razona la respuesta en el examen del tema."
JAVA = "public class Persona { private String nombre; public String getNombre() { return nombre; } public void setNombre(String n) { this.nombre = n; } }"
SPRING = 'Vamos a ver el controlador de ejemplo.\n\n```java\n@RestController\npublic class UsuarioController {\n    @GetMapping("/usuarios")\n    public List<Usuario> todos() {\n        return servicio.buscarTodos();\n    }\n}\n```\n'
VIRTUES = "Las ventajas de la herencia son tres. 1. Reutilizacion del codigo comun. 2. Extension del comportamiento. 3. Polimorfismo entre las clases derivadas."
PADAWAN = "NIVEL PADAWAN\n1. Escribe un programa que de los buenos dias.\n2. Escribe un programa que calcule el area de un cuadrado de lado 5.\n3. Escribe un programa que lea dos numeros y muestre su suma.\n"
TEST = "95. ¿Que metodo se ejecuta cuando un cliente se conecta?\na) OnConnected().\nb) OnConnectedAsync().\nc) ConnectAsync().\nd) Ninguno.\n"
MEMORY = "La memoria virtual permite que un proceso use mas memoria de la fisica disponible. El sistema operativo mantiene una tabla de paginas que traduce las direcciones logicas en fisicas, y lleva a disco las paginas que llevan mas tiempo sin usarse."
SWING = "void setSelectionMode(int) Selecciona los intervalos de seleccion permitidos en la tabla. Los valores validos estan definidos en ListSelectionModel como SINGLE_SELECTION y MULTIPLE_INTERVAL_SELECTION, que es el valor por defecto.\nvoid setSelectionModel(ListSelectionModel) Selecciona el modelo usado para controlar las selecciones de la tabla, y devuelve el modelo anterior."
PYTHON = 'reExpresion = "[0-9a-zB]bc"\nprint "Corchetes mas rango concatenado"\nprint "Si" if (re.match(reExpresion, "Abc")) else "No"\nfrom re import match\n'
IS = [
    ("class Foo {}", "", True, "codigo"), ("Real Decreto 686/2010, anexo I", "", False, "normativa"), ("Ejemplo 3: el caso resuelto paso a paso", "", False, "ejemplo_resuelto"),
    (DEFINITION, "", False, "definicion"), (STEPS, "", False, "procedimiento"), (JAVA, "", False, "codigo"), (SPRING, "", False, "codigo"), (PADAWAN, "ud4_Ejercicios", False, "enunciado_ejercicio"),
    (TEST, "Test de ASP.NET Core", False, "enunciado_ejercicio"), (PYTHON, "expresiones_regulares", False, "codigo"),
    ("Primero, abre el editor. Luego, pulsa el botón. Por último, guarda el fichero.", "", False, "procedimiento"), ("systemctl stop x\napt-get install y\nsystemctl start x\nListo.", "", False, "procedimiento"),
    ("Real Decreto 686. Resultados de aprendizaje del anexo", "", False, "normativa"), ("## Ejemplo resuelto\nUno y dos.", "", False, "ejemplo_resuelto"), (None, None, None, "explicacion"), ("", "", False, "explicacion"),
]
IS_NOT = [(QUESTION, "", "definicion"), ("El bucle es una estructura repetitiva.", "", "definicion"), (VIRTUES, "", "procedimiento"), (MEMORY, "Practica 3 de sistemas", "enunciado_ejercicio"), (SWING, "5.- Swing", "codigo")]


def test_kinds(spark):
    rows = [(i, t, n, c) for i, (t, n, c, _) in enumerate(IS)]
    got = spark.createDataFrame(rows, "i int, t string, n string, c boolean").select("i", T.content_kind(F.col("t"), F.col("n"), F.col("c"))).collect()
    assert {r[0]: r[1] for r in got} == {i: k for i, (*_, k) in enumerate(IS)}
    got = spark.createDataFrame([(t, n, k) for t, n, k in IS_NOT], "t string, n string, k string").select(T.content_kind(F.col("t"), F.col("n")), "k").collect()
    assert all(r[0] != r[1] for r in got)


def test_defining_sentences(spark):
    cases = [
        (DEFINITION, DEFINITION.split(". ")[0] + "."), ("El índice es el que se encarga de ordenar las filas.", None), ("La suma es una de las tareas más comunes aquí.", None),
        ("Se entiende por clave todo lo que identifica una fila.", "Se entiende por clave todo lo que identifica una fila."), ("¿La clave ajena es una columna de la tabla?", None),
        ("Sobra. El enlace troncal consiste en unir dos conmutadores.", "El enlace troncal consiste en unir dos conmutadores."), ("La clave es una\n* columna de la tabla otra.", None), ("Una clave ajena es cosa de dos tablas.", None), (None, None),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", T.defining_sentence(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == {i: w for i, (_, w) in enumerate(cases)}


@pytest.mark.parametrize("line,code", [('print("x")', 1), ("from os import path", 1), ("x = [1,2]", 1), ("return x", 1), ("  }", 1), ("a.b(c) ;", 1), ("if (x)", 1), ("una frase normal", 0), ("prints a lot", 0), ("x = y", 0)])
def test_lines_of_code(spark, line, code):
    assert spark.range(1).select(T.code_share(F.lit(line))).first()[0] == code


BODY = "\n".join(f'        System.out.println("linea {{ {i}");' for i in range(60))
LARGE = f"public class Grande {{\n    public void primero() {{\n{BODY}\n    }}\n\n    /** Javadoc }} */\n    @Override\n    private static <T> List<T> segundo(int a, List<String> b) throws IOException {{\n{BODY}\n    }}\n}}\n"


def test_code_is_cut_where_methods_begin():
    small = "package ejemplo;\n\npublic class Calculadora {\n    public int sumar(int a, int b) {\n        return a + b;\n    }\n}\n"
    assert T.cut_code(small, 480) == ([small], None)
    pieces, warning = T.cut_code(LARGE, 480)
    assert "".join(pieces) == LARGE and len(pieces) == 2 and pieces[1].lstrip().startswith("/** Javadoc")
    flat = "\n".join(f"int variable{i} = {i};" for i in range(400))
    assert T.cut_code(flat, 200) == ([flat], "no class or method to cut at")
    assert T.cut_code("", 10) == ([], None) == T.cut_code(" \n", 10)
    assert T.cut_code(LARGE, 100)[1] == "2 pieces over 100 tokens"


def named(text):
    return [(k, name, depth, text[b:e]) for b, e, k, name, depth in T.code_blocks(text)]


def test_blocks_in_braces():
    got = named(LARGE)
    assert [(k, n, d) for k, n, d, _ in got] == [("class", "Grande", 0), ("method", "primero", 1), ("method", "segundo", 1)]
    assert got[0][3] == LARGE.rstrip("\n") and got[1][3].strip().endswith("}") and got[1][3].count("println") == 60
    odd = 'class A {\n  int f = g(1) + 2;\n  A() { x = new int[] { 1, 2 }; if (a(b)) { while (c) { d(); } } else { e(); } }\n  char q = \'{\'; // {{{\n  String s = "\\"{";\n  enum E { X, Y }\n  Runnable r = () -> { run(); };\n  void last(int a, Map<K, V> b)\n  {\n    return;\n'
    assert [(k, n, d) for k, n, d, _ in named(odd)] == [("class", "A", 0), ("method", "A", 1), ("class", "E", 1), ("method", "last", 1)]
    assert named(odd)[-1][3].endswith("return;\n")  # never closed
    assert named("function f(a) {\n}\nfor (;;) { x(); }\n")[0][:2] == ("method", "f")
    assert named("} } ) { x") == [] and named('"{ never closed') == []


def test_blocks_by_indent():
    text = "import os\n\n@a\n@b(1)\nclass C:\n    x = {1: 2}\n\n    def f(self):\n        if x:\n\n            return {}\n\n    async def g(self):  # why\n        pass\n\n\ndef h():\n    return 1\nprint(1)\n"
    assert [(k, n, d) for k, n, d, _ in named(text)] == [("class", "C", 0), ("method", "f", 1), ("method", "g", 1), ("method", "h", 0)]
    blocks = {n: t for _, n, _, t in named(text)}
    assert blocks["C"].startswith("@a\n@b(1)\nclass C:") and blocks["C"].endswith("pass\n") and blocks["f"].endswith("return {}\n") and blocks["h"] == "def h():\n    return 1\n"
    many = "\n".join(f"def f{i}(a):\n" + "    a = a + 1\n" * 30 for i in range(6))
    pieces, warning = T.cut_code(many, 300)
    assert "".join(pieces) == many and len(pieces) > 2 and all(p.startswith("def f") for p in pieces) and warning is None


def test_code_chunks(spark):
    df = spark.createDataFrame([(1, LARGE), (2, None), (3, "x = 1\n"), (4, "")], "doc long, source string")
    got = sorted(tuple(r) for r in T.code_chunks(df, "doc", "source", 480).select("doc", "ord", "kind", "name", "warning").collect())
    assert got == [(1, 0, "class", "Grande", "2 pieces over 480 tokens"), (1, 1, "method", "segundo", "2 pieces over 480 tokens"), (3, 0, None, None, None)]


def test_claims_in_raw_answers(spark):
    raw = '{"afirmaciones":[{"tipo": "cita", "cita": "dos \\"ü\\" más"},{"tipo":"cita","cita" : ""}, {"tipo" : "calculo", "cita": "sin f'
    got = spark.createDataFrame([(1, raw), (2, '"type": 1'), (3, "")], "i int, t string").select("i", X.claims_in(F.col("t")).alias("c")).select("i", "c.*").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 2, 13, 13), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]


def test_accents_of_any_letter(spark):
    cases = {"Ấ ő Ł ñ Ç ǘ": "A o Ł n C u", "ẹ́x": "ex", "ёй": "еи", "ΐ": "ι", "日本": "日本", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.strip_accents(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_titles(spark):
    from lantern.functions import corpus

    cases = [
        ("corpus/x/despliegue.md", "# apt-get install eclipse\n\nInstalamos.\n\n# Despliegue de aplicaciones web\n\nContenido.", "Despliegue de aplicaciones web"),
        ("corpus/x/DAW05.pdf.md", "# /etc/init.d/nscd restart\n\ntexto", "DAW05"), ("corpus/x/a.md", "# systemctl restart x\n\ntexto", "a"), ("corpus/x/b.md", "# aptitudes del alumno\n", "aptitudes del alumno"),
        ("corpus/x/12-redis.md", "# Redis Caching ##\n\ntexto", "Redis Caching"), ("corpus/x/expresiones.txt", "# -*- coding: utf-8 -*-\nprint 1", "expresiones"), ("c.markdown", "## ab\n### " + "x" * 81 + "\n# Buen título\n", "Buen título"), ("d.md", None, "d"),
    ]
    got = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(cases)], "i int, p string, t string").select("i", corpus.title_of(F.col("p"), F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == {i: w for i, (*_, w) in enumerate(cases)}
