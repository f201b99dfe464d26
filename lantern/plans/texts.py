"""Queries over texts: gates, personal data, coverage, verdicts, chunks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.functions import calc, curriculum, teaching
from lantern.functions import text as X
from lantern.operators import dating, evidence, ingest, verify
from lantern.sources import files
from lantern.streaming import tokens

from .registry import query, read

DROP = "['de','la','el','los','las','un','una','y','o','que','en','para','con','por','se','es','son','del','al','como','su','sus']"
WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-záéíóúñ]{{4,}}')), lambda w: NOT list_contains(" + DROP + ", w))"


@query(f"""WITH w AS (SELECT conv_id, turn, {WORDS.format('text')} AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(w || b)) > 0 THEN len(list_intersect(w, b)) / len(list_distinct(w || b)) ELSE 0.0 END, 6) AS jaccard, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, b)) / len(w) ELSE 0.0 END, 6) AS coverage FROM p WHERE b IS NOT NULL""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", X.content_words(F.col("text")).alias("w"))
    rows = rows.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return rows.select("conv_id", "turn", F.round(X.jaccard(F.col("w"), F.col("b")), 6).alias("jaccard"), F.round(X.coverage(F.col("b"), F.col("w")), 6).alias("coverage"))


@query("""WITH n AS (SELECT doc_id, replace(substr(text, 11, 60), ' ', '  ') AS needle, text FROM documents),
c AS (SELECT doc_id, text, needle, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(needle, '\\s+', ' ', 'g')) AS n FROM n)
SELECT doc_id, length(trim(needle)) > 0 AND contains(text, needle) AS exact, length(n) > 0 AND contains(t, n) AS spaces, length(n) > 0 AND contains(lower(t), lower(n)) AS lower FROM c""")
def literal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "documents").select("doc_id", "text", F.replace(F.substring("text", 11, 60), F.lit(" "), F.lit("  ")).alias("needle"))
    return n.select("doc_id", *(X.holds(F.col("text"), F.col("needle"), level).alias(level) for level in ("exact", "spaces", "lower")))


@query("""WITH w AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 0)) AS n_words, len(regexp_extract_all(text, '[.!?;]|:(\\s|$)')) AS marks FROM documents)
SELECT doc_id, n_words, round(CASE WHEN n_words > 0 THEN marks / n_words ELSE 0.0 END, 6) AS punctuation FROM w""")
def prose_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words"), F.round(X.punctuation_per_word(F.col("text")), 6).alias("punctuation"))


# The rules of the chunk gate, said again for SQL: l are the lines with something on them, w the words.
MACHINE = {
    "package manager output": "(Setting up |Unpacking |Get:[0-9]|Reading package lists|Preparing to unpack|[0-9]+ upgraded, [0-9]+ newly|Need to get [0-9]|After this operation)",
    "mail headers": "(DKIM-Signature:|Received: from|Content-Transfer-Encoding:|X-Spam|MIME-Version:|^\\s*b?h?=[A-Za-z0-9+/=]{40,})",
    "console output": "(icmp_seq=|link/ether|64 bytes from|PING \\S+ \\(|inet6? [0-9]|rtt min/avg/max)",
}
SHARE = "len(list_filter(l, lambda x: regexp_matches(x, '{0}'))) / len(l)"
PARTS = """p AS (SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 0) AS w,
len(regexp_extract_all(text, '[.!?;]|:(\\s|$)')) AS marks, len(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÑáéíóúñ][^.!?\\n]{30,}[.!?]')) AS sentences, regexp_replace(text, '(https?://|ftp://|www\\.)\\S+', ' ', 'g') AS rest FROM documents),
v AS (SELECT doc_id, source, len(w) AS n_words, marks, CASE WHEN regexp_matches(text, '(?i)(403 Forbidden|Directory access is forbidden|Index of /)') THEN 'directory page' """ + " ".join(f"WHEN len(l) > 0 AND {SHARE.format(x)} >= 0.4 THEN '{name}'" for name, x in MACHINE.items()) + f""" WHEN len(l) > 5 AND {SHARE.format('^\\s*[-*]?\\s*\\[[^\\]]+\\]\\([^)]+\\)\\s*$')} > 0.6 THEN 'list of links'
WHEN len(l) > 8 AND {SHARE.format('^\\s*\\S[^\\n]{0,48}?\\s+[0-9]{1,4}(\\s*,\\s*[0-9]{1,4})*\\s*$')} > 0.6 AND sentences <= 1 THEN 'index' WHEN len(w) >= 40 AND marks / len(w) < 0.02 AND sentences = 0 THEN 'no prose'
WHEN len(w) = 0 OR list_sum(list_transform(list_filter(regexp_extract_all(rest, '\\b[A-Za-z0-9+/=]{{24,}}\\b'), lambda x: regexp_matches(x, '[0-9]')), lambda x: length(x))) / greatest(length(rest), 1) > 0.25 THEN 'dump of long tokens' END AS reason FROM p)"""


@query(f"WITH {PARTS} SELECT doc_id, reason FROM v")
def chunk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.chunk_verdict(F.col("text")).alias("reason"))


@query(f"""WITH {PARTS}, g AS (SELECT source, count(*) AS n, count(reason) AS n_refused, count(*) AS n_prose, sum(n_words)::BIGINT AS n_words, sum(marks)::BIGINT AS n_marks FROM v GROUP BY 1)
SELECT *, CASE WHEN n = n_refused THEN 'all refused' WHEN n_words >= 60 AND n_marks < 0.02 * n_words THEN 'no prose' WHEN n_words >= 60 AND n >= 5 AND n_refused > 0.6 * n THEN 'most refused' END AS refused FROM g""")
def document_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source judged as one document, whose chunks are the rows."""
    rows = read(spark, sf_dir, "documents").withColumn("kind", F.lit("explicacion"))
    return ingest.document_gate(rows, "source", X.chunk_verdict(F.col("text"), F.col("kind")))


# Phones have no digit before or after them; as this dialect cannot look around, all other signs are doubled first.
PII = """WITH t AS (SELECT doc_id, text, regexp_replace(text, '([^0-9])', '\\1\\1', 'g') AS d FROM documents),
v AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}_][\\p{L}\\p{N}_.+-]*@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.]+[\\p{L}\\p{N}_]') AS email,
regexp_extract_all(d, '(^|[^0-9])((\\+\\+34(  |--)?)?[6789][0-9]{2}(  |--)?[0-9]{3}(  |--)?[0-9]{3})([^0-9]|$)', 2) AS phone, regexp_extract_all(text, '\\b[0-9]{5}\\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(\\s+[A-Za-záéíóúñ]+){0,3},?\\s*[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+') AS address,
regexp_extract_all(text, '(?i)\\b(twitter|linkedin|facebook|instagram|medium)\\s*:') AS profile, regexp_extract_all(text, '(?i)\\b([0-9]{8})[ -]?([A-HJ-NP-TV-Z])\\b') AS dni FROM t),
n AS (SELECT doc_id, text, len(regexp_extract_all(text, '\\S+')) AS words, """ + ", ".join(f"len(list_distinct(list_transform({c}, lambda x: lower(replace(replace({x}, ' ', ''), '-', '')))))::INT AS {c}" for c, x in (("email", "x"), ("phone", "replace(x, '++', '+')"), ("address", "x"), ("profile", "x"))) + """,
len(list_filter(dni, lambda x: substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(substr(x, 1, 8)::BIGINT % 23 + 1 AS INT), 1) = upper(right(x, 1)))) > 0 AS national FROM v),
s AS (SELECT *, email + phone + address + profile AS signals, (email > 0)::INT + (phone > 0)::INT + (address > 0)::INT + (profile > 0)::INT AS classes FROM n)
SELECT doc_id, email, phone, address, profile, signals, round(1000 * signals / greatest(words, 1), 6) AS density, CASE WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private_key' WHEN contains(text, '-----BEGIN CERTIFICATE-----') THEN 'certificate'
WHEN regexp_matches(text, '\\b(ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9-]{10,})\\b') THEN 'token' WHEN regexp_matches(text, '\\bES[0-9]{2} ?[0-9]{4} ?[0-9]{4} ?[0-9]{2} ?[0-9]{10}\\b') THEN 'iban'
WHEN regexp_matches(text, '[A-ZÁÉÍÓÚÑ]{3,}\\s+[A-ZÁÉÍÓÚÑ]{3,},\\s*[A-ZÁÉÍÓÚÑ ]{3,},\\s*[0-9][A-Za-z],(\\s*[0-9]+,){3}') THEN 'grade_roster' WHEN national THEN 'national_id' WHEN classes >= 2 AND signals >= 3 AND 1000 * signals / greatest(words, 1) >= 10 THEN 'personal_density' END AS blocking FROM s"""


@query(PII)
def pii_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.with_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.withColumn("density", F.round("density", 6)).drop("text")


@query("""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT source, doc_id, regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '[0-9]+', '#', 'g') AS signature FROM l),
n AS (SELECT source, count(DISTINCT doc_id) AS n_pages FROM documents GROUP BY 1), c AS (SELECT source, signature, count(DISTINCT doc_id) AS n FROM s WHERE length(signature) BETWEEN 4 AND 90 GROUP BY 1, 2) SELECT source, signature, n, n_pages FROM c JOIN n USING (source) WHERE n > n_pages * 0.02""")
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return ingest.furniture(lines, "source", "doc_id", "line", 0.02)


@query("""SELECT o_orderkey, substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(o_orderkey % 23 + 1 AS INT), 1) AS letter FROM orders""")
def national_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", X.national_letter(F.col("o_orderkey")).alias("letter"))


@query("""
WITH c AS (SELECT o_orderkey, o_orderkey AS k, o_custkey AS c, (o_orderkey // 16) % 2 AS off, o_orderkey % 16 AS kind, o_orderkey % 23 + 2 AS n FROM orders),
t AS (SELECT *, CASE kind WHEN 0 THEN 3 * k - 7 WHEN 1 THEN (3 * k + 1) / 3.0 WHEN 2 THEN pow(2, n) * pow(2, n) WHEN 3 THEN factorial(n::INT)::DOUBLE / factorial((n - 2)::INT)::DOUBLE
    WHEN 4 THEN gcd(6 * k, 9 * k) WHEN 5 THEN lcm(4 * k, 6 * k) WHEN 6 THEN floor(k / 7) + ceil(-k / 7) WHEN 7 THEN c % 97 + 97 * floor(c / 97)
    WHEN 8 THEN factorial(n::INT)::DOUBLE / 2 / factorial((n - 2)::INT)::DOUBLE WHEN 9 THEN sqrt(k * k + 2 * k + 1) WHEN 10 THEN ln(exp(n)) WHEN 11 THEN pow(sin(k), 2) + pow(cos(k), 2) END AS truth,
  CASE kind WHEN 0 THEN 3 * k - 7 WHEN 1 THEN k + 0.33 WHEN 2 THEN pow(4, n) WHEN 3 THEN n * (n - 1) WHEN 4 THEN 3 * k WHEN 5 THEN 12 * k WHEN 6 THEN 0 WHEN 7 THEN c
    WHEN 8 THEN n * (n - 1) / 2 WHEN 9 THEN k + 1 WHEN 10 THEN n WHEN 11 THEN 1 END + off AS said FROM c)
SELECT o_orderkey, CASE WHEN truth IS NULL THEN 'no_verificable' WHEN abs(truth - said) <= 0.005 THEN 'verificada' ELSE 'podada' END AS verdict,
  CASE kind WHEN 12 THEN 'factorial_excesivo' WHEN 13 THEN 'nombre_no_permitido' WHEN 14 THEN 'resultado_mal_formado' WHEN 15 THEN 'sin_valor_numerico'
    ELSE CASE WHEN abs(truth - said) > 0.005 THEN 'resultado_no_coincide' END END AS reason FROM t""")
def calc_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of twelve kinds that are right or off by one, and four kinds that can't be checked."""
    k, c, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 23 + 2
    off = F.floor(k / 16) % 2
    four = F.pow(F.lit(4.0), n).cast("decimal(20,0)")
    kinds = [
        ("%s*3-7", [k], 3 * k - 7), ("(%s*3+1)/3", [k], None), ("2^%s * 2**%s", [n, n], four), ("%s! / (%s-2)!", [n, n], n * (n - 1)), ("gcd(6*%s, 9*%s)", [k, k], 3 * k), ("lcm(4*%s, 6*%s)", [k, k], 12 * k),
        ("floor(%s/7) + ceiling(-%s/7)", [k, k], F.lit(0)), ("mod(%s, 97) + 97*floor(%s/97)", [c, c], c), ("binomial(%s,2)", [n], n * (n - 1) / 2), ("sqrt(%s^2 + 2*%s + 1)", [k, k], k + 1), ("ln(exp(%s))", [n], n),
        ("sin(%s)^2 + cos(%s)^2", [k, k], F.lit(1)), ("factorial(100000 + %s)", [k], k), ("x + %s", [k], k), ("%s*2", [k], None), ("%s/(%s-%s)", [k, c, c], k),
    ]
    e, r = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (text, parts, said) in enumerate(kinds):
        written = F.concat((k + off).cast("string"), F.lit(",33" if kind == 1 else ".500")) if said is None else (said + off).cast("decimal(22,0)").cast("string")
        e = F.when(k % 16 == kind, F.format_string(text, *(p.cast("string") for p in parts))).otherwise(e)
        r = F.when(k % 16 == kind, written).otherwise(r)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    claims = orders.select("o_orderkey", calc.calc_verdict(e, r).alias("v"))  # dealt, as one file of a few MB is one task, and a claim costs more than its row
    return claims.select("o_orderkey", "v.verdict", "v.reason")


@query()
def mode_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.turn_mode(F.col("text")).alias("mode"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH s AS (SELECT conv_id, turn, regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+$') AS p FROM conversations) SELECT conv_id, turn, len(p)::INT AS n, sum(length(x))::BIGINT AS chars FROM (SELECT conv_id, turn, p, unnest(p) AS x FROM s) GROUP BY 1, 2, 3""")
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    cut = tokens.gated_batch(rows, "id", "text")
    return cut.groupBy("id.conv_id", "id.turn").agg(F.count("*").cast("int").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query()
def sentence_backing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each answer against the words of the turn before it."""
    c = read(spark, sf_dir, "conversations")
    rows = c.withColumn("support", X.content_words(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))).where("role = 'assistant'")
    rows = rows.select("conv_id", "turn", "support", F.explode(X.gated(F.col("text"))).alias("s"))
    return rows.groupBy(verify.sentence_backing(F.col("s"), F.coalesce("support", F.array().cast("array<string>"))).alias("backing")).agg(F.count("*").alias("n"))


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


KINDS = [
    ("codigo", "ud", ["public class C", "id", " {\n  int x = ", "id", ";\n}\n"]),
    ("codigo", "expresiones", ["re", "id", " = \"[0-9]bc\"\nprint \"Corchetes\"\nfrom re import match\n"]),
    ("enunciado_ejercicio", "ud4_Ejercicios", ["1. Escribe un programa.\n2. Calcula ", "id", " por dos.\n"]),
    ("enunciado_ejercicio", "tema", ["Debes entregarlo. Realiza ", "id", " pasos; indica el resultado; explica el porqué."]),
    ("procedimiento", "ud", ["Primero, abre ", "id", ". Luego, pulsa aceptar. Por último, guarda los cambios."]),
    ("procedimiento", "ud", ["systemctl stop s", "id", "\napt-get install x\nsystemctl start x\nY ya está."]),
    ("ejemplo_resuelto", "ud", ["## Ejemplo resuelto\nCon ", "id", " filas."]),
    ("definicion", "ud", ["La clave ajena es una columna que referencia a otra tabla ", "id", ". " + "Sigue el texto con palabras que no cuentan. " * 4]),
    ("explicacion", "ud", ["El índice es el que se encarga de ordenar las filas de la tabla ", "id", ". " + "Sigue el texto con palabras que no cuentan. " * 4]),
    ("normativa", "ud", ["Real Decreto ", "id", ". Resultados de aprendizaje del anexo."]),
    ("explicacion", "Practica 3", ["La memoria ", "id", " permite que un proceso use más de la que hay."]),
]


@query("SELECT doc_id, CASE doc_id % " + str(len(KINDS)) + " " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _, _) in enumerate(KINDS)) + " END AS kind FROM documents")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every kind, with what only looks like one, about each document."""
    n = F.col("doc_id") % len(KINDS)
    text, title = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (_, t, parts) in enumerate(KINDS):
        text = F.when(n == i, F.concat(*(F.col("doc_id").cast("string") if p == "id" else F.lit(p) for p in parts))).otherwise(text)
        title = F.when(n == i, F.lit(t)).otherwise(title)
    return read(spark, sf_dir, "documents").select("doc_id", teaching.content_kind(text, title).alias("kind"))


CODE_LINE_SQL = teaching.CODE_LINE.removeprefix("(?Ud)").replace("\\w", "[\\p{L}\\p{N}_]").replace("'", "''")


@query(f"""WITH l AS (SELECT doc_id, lang, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\s\\x{{A0}}]')) AS l, len(string_split(coalesce(text, ''), '```')) AS f FROM documents),
s AS (SELECT lang, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(x, '{CODE_LINE_SQL}'))) AS c FROM l WHERE f < 3)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE c > 0) AS n_some, count(*) FILTER (WHERE n > 0 AND c / n >= 0.2) AS n_much, round(sum(CASE WHEN n > 0 THEN c / n ELSE 0 END), 6) AS total FROM s GROUP BY 1""")
def code_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the documents' lines looks like code, those with fences apart."""
    rows = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).where(F.size(F.split("text", "```")) < 3)
    rows = rows.select("lang", teaching.code_share(F.col("text")).alias("s"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("s") > 0).alias("n_some"), F.count_if(F.col("s") >= 0.2).alias("n_much"), F.round(F.sum("s"), 6).alias("total"))


@query("""WITH k AS (SELECT doc_id, doc_id % 5 + 1 AS n FROM documents), m AS (SELECT doc_id, n, unnest(range(0, n)) AS i FROM k)
SELECT doc_id, CAST(i AS INT) AS ord, 'm' || i || '_' || doc_id AS name, 'method' AS kind FROM m WHERE i > 0 UNION ALL SELECT doc_id, 0, 'C' || doc_id, 'class' FROM k WHERE doc_id IS NOT NULL""")
def code_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with strings and comments full of brackets, cut where methods begin."""
    body = "        // no } { end\n" + '        String s = "{ \\" ( ";\n        for (int i = 0; i < 9; i++) { if (i > 1) { x(i); } }\n' * 8
    method = lambda i: F.concat(F.lit("    @Test\n    public int m"), i.cast("string"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("(int a) {\n" + body + "        return a;\n    }\n"))
    methods = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 5), method)
    source = F.concat(F.lit("package x;\n\npublic class C"), F.col("doc_id").cast("string"), F.lit(" {\n"), F.array_join(methods, ""), F.lit("}\n"))
    pieces = teaching.code_chunks(read(spark, sf_dir, "documents").select("doc_id", source.alias("text")), "doc_id", "text", 200)
    return pieces.select("doc_id", "ord", F.coalesce("name", F.concat(F.lit("C"), F.col("doc_id").cast("string"))).alias("name"), F.coalesce("kind", F.lit("class")).alias("kind"))


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS kind, doc_id % 5 + 4 AS p, length('Cuerpo del documento ' || doc_id) AS n FROM documents)
SELECT doc_id, CAST(p AS INT) AS pages, CASE kind WHEN 2 THEN 'signatures' WHEN 3 THEN 'all' ELSE 'nothing' END AS undone,
  CASE kind WHEN 2 THEN (n + 29) * p - 2 WHEN 3 THEN 44 * p - 2 ELSE (n + 97) * p - 2 END AS chars, CASE kind WHEN 2 THEN (n + 29) * p - 2 WHEN 3 THEN 0 ELSE (n + 121) * p - 2 END AS unique_chars FROM d""")
def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with running heads and numbers; with lines that differ in a number only and are the content; and with nothing else.

    Each page ends in its letter, so that bodies are no repetition of each other.
    """
    body = F.concat(F.lit("Cuerpo del documento "), F.col("doc_id").cast("string"))
    letter = lambda i: F.substring(F.lit("ABCDEFGHIJ"), i + 1, F.lit(1))
    number = lambda i: F.lpad((i + 10).cast("string"), 2, "0")

    def page(i):
        own = F.concat(body, F.lit(" pág. "), letter(i), F.lit(". Es un texto con bastantes palabras, para que pese más que sus cabeceras y pies, todos."))
        heads = F.concat(F.lit("PROGRAMACIÓN / CFGS DAW\nTEMA 6-"), number(i), F.lit(" Página "), number(i), F.lit(" ISO\n"), own, F.lit("\nalgo de relleno en medio\n"), F.lit("- "), number(i), F.lit(" -"))
        same = F.concat(F.lit("Esta línea está en todas las páginas iguales"))
        numbered = F.concat(body, F.lit(" ejercicio número "), number(i), F.lit(" de hoy"))
        return F.when(F.col("kind") < 2, F.replace(heads, F.lit("algo de relleno en medio\n"), F.lit(""))).when(F.col("kind") == 2, numbered).otherwise(F.substring(same, 1, 42))

    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("kind"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 5 + 3).cast("int")), page), "\f")
    found = ingest.clean_documents(rows.select("doc_id", text.alias("text")), "doc_id")
    return found.select("doc_id", "pages", "undone", F.length("text").cast("long").alias("chars"), "unique_chars")


@query("""WITH e AS (SELECT doc_id AS n, doc_id % 11 AS kind, 'corpus/' || coalesce(source, 's') || '/' || coalesce(lang, 'l') AS f FROM documents),
p AS (SELECT n, kind, CASE kind WHEN 0 THEN f || '/RD-686-2010-' || n || '.txt' WHEN 1 THEN f || '/u' || n % 3 || '/d' || n || '.pdf' WHEN 2 THEN f || '/u' || n % 3 || '/e' || n || '.PDF' WHEN 5 THEN 'corpus/familia/x' || n || '.md'
  WHEN 6 THEN 'corpus/derivado/familia/x' || n || '.md' WHEN 7 THEN f || '/otro/y' || n || '.md' WHEN 8 THEN 'lejos/a' || n WHEN 9 THEN 'lejos/b' || n WHEN 10 THEN 'lejos2/c' || n ELSE f || '/u' || n % 3 || '/x' || n || '.java' END AS path,
  CASE WHEN kind = 1 THEN '2020-01-0' || (n // 11 % 3 + 1) END AS pdf, CASE WHEN kind = 10 AND n % 2 = 0 THEN '1999-01-01' END AS known, CASE kind WHEN 8 THEN n - 7 WHEN 9 THEN n - 1 WHEN 10 THEN n + 11 END AS made_of FROM e),
o AS (SELECT *, CASE kind WHEN 0 THEN '2010-06-12' WHEN 1 THEN pdf WHEN 5 THEN '2019-01-01' WHEN 6 THEN '2019-01-01' END AS own, regexp_replace(path, '/?[^/]*$', '') AS f1, regexp_replace(regexp_replace(path, '/?[^/]*$', ''), '/?[^/]*$', '') AS f2 FROM p),
v AS (SELECT f1 AS folder, own, row_number() OVER (PARTITION BY f1 ORDER BY count(*) DESC, min(n)) AS r FROM o WHERE own IS NOT NULL GROUP BY 1, 2), b AS (SELECT folder, own AS date FROM v WHERE r = 1),
r AS (SELECT o.*, coalesce(own, x.date, y.date) AS date, CASE WHEN kind = 0 THEN 'norma' WHEN kind = 1 THEN 'metadatos_pdf' WHEN own IS NOT NULL THEN 'texto' WHEN coalesce(x.date, y.date) IS NOT NULL THEN 'carpeta' END AS origin FROM o LEFT JOIN b x ON f1 = x.folder LEFT JOIN b y ON f2 = y.folder),
i8 AS (SELECT a.n, b.date FROM r a JOIN r b ON a.made_of = b.n WHERE a.kind = 8), i9 AS (SELECT a.n, i8.date FROM r a JOIN i8 ON a.made_of = i8.n WHERE a.kind = 9), i10 AS (SELECT a.n, b.known AS date FROM r a JOIN r b ON a.made_of = b.n WHERE a.kind = 10 AND b.known IS NOT NULL),
i AS (SELECT * FROM i8 UNION ALL SELECT * FROM i9 UNION ALL SELECT * FROM i10)
SELECT r.n, coalesce(r.date, i.date) AS date, CASE WHEN r.date IS NOT NULL THEN r.origin WHEN i.date IS NOT NULL THEN 'heredada' END AS origin FROM r LEFT JOIN i ON r.n = i.n""")
def source_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of eleven kinds, laid out by source and language, dated by all five means."""
    n, s = F.col("doc_id"), lambda c: c.cast("string")
    kind, unit = n % 11, F.concat(F.lit("/u"), s(n % 3))
    f = F.concat(F.lit("corpus/"), F.coalesce("source", F.lit("s")), F.lit("/"), F.coalesce("lang", F.lit("l")))
    paths = {
        0: F.concat(f, F.lit("/RD-686-2010-"), s(n), F.lit(".txt")), 1: F.concat(f, unit, F.lit("/d"), s(n), F.lit(".pdf")), 2: F.concat(f, unit, F.lit("/e"), s(n), F.lit(".PDF")), 5: F.concat(F.lit("corpus/familia/x"), s(n), F.lit(".md")),
        6: F.concat(F.lit("corpus/derivado/familia/x"), s(n), F.lit(".md")), 7: F.concat(f, F.lit("/otro/y"), s(n), F.lit(".md")), 8: F.concat(F.lit("lejos/a"), s(n)), 9: F.concat(F.lit("lejos/b"), s(n)), 10: F.concat(F.lit("lejos2/c"), s(n)),
    }
    path = F.concat(f, unit, F.lit("/x"), s(n), F.lit(".java"))
    for k, p in paths.items():
        path = F.when(kind == k, p).otherwise(path)
    docs = read(spark, sf_dir, "documents").select(
        n.alias("n"), path.alias("path"), F.when(kind == 1, F.concat(F.lit("2020-01-0"), s(F.floor(n / 11) % 3 + 1))).alias("pdf_date"), F.when((kind == 10) & (n % 2 == 0), "1999-01-01").alias("known_date"),
        F.when(kind == 8, n - 7).when(kind == 10, n + 11).alias("d"), F.when(kind == 9, n - 1).alias("p"),
    )
    names = docs.select(F.col("n").alias("m"), F.col("path").alias("of"))
    docs = docs.join(names, F.col("d") == F.col("m"), "left").withColumn("derived_from", F.coalesce("of", F.when(F.col("d").isNotNull(), "nowhere"))).drop("m", "of")
    docs = docs.join(names, F.col("p") == F.col("m"), "left").withColumn("planted_from", F.col("of"))
    return dating.dated(docs, [("RD-686-2010", "2010-06-12"), ("RD-405-2023", "2023-06-03")], [("corpus/familia", "2019-01-01", "texto: año citado")]).select("n", "date", "origin")


@query(f"""WITH c AS (SELECT conv_id, turn, {WORDS.format("coalesce(text, '')")} AS own, conv_id % 3 AS kind FROM conversations)
SELECT conv_id, turn, CASE kind WHEN 0 THEN len(list_distinct(own || ['palabra', 'citada'])) WHEN 1 THEN 2 ELSE len(list_distinct(own || ['suelta', 'igual', 'palabra', 'citada'])) END AS n FROM c""")
def prose_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words back an answer, of claims with scaffolding that holds a sum, or none."""
    kind = F.col("conv_id") % 3
    told = F.when(kind == 1, F.concat(F.coalesce("text", F.lit("")), F.lit(" y así 64 - 2 = 62 equipos"))).when(kind == 2, F.concat(F.coalesce("text", F.lit("")), F.lit(" suelta igual"))).otherwise(F.coalesce("text", F.lit("")))
    claims = F.array(F.to_json(F.struct(F.when(kind == 0, "conocimiento").otherwise("andamiaje").alias("tipo"), told.alias("texto"))), F.lit('{"tipo": "literal", "cita": "una palabra citada"}'))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(verify.support_of(claims)).alias("n"))


@query("""SELECT doc_id, md5(strip_accents(text || ' Ấ ő ç Ł é' || chr(769))) AS plain FROM documents""")
def unaccented_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without accents, with some letters that no short table has."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip_accents(F.concat("text", F.lit(" Ấ ő ç Ł é\u0301")))).alias("plain"))


@query("""WITH m AS (SELECT doc_id, unnest(range(0, doc_id % 3 + 1)) AS i FROM documents), u AS (SELECT doc_id, i, unnest(range(0, i + 1)) AS j FROM m WHERE i < 2)
SELECT doc_id, CAST(1000 + i AS VARCHAR) AS code, 'module' AS level, 0 AS n, 'Gestión de datos ' || doc_id || ' y sistemas de información' AS name, CAST(i + 1 AS INT) AS page FROM m
UNION ALL SELECT doc_id, CAST(1000 + i AS VARCHAR), 'outcome', CAST(j AS INT), 'Reconoce ' || doc_id || ' características del apartado ' || j, CAST(i + 1 AS INT) FROM u
UNION ALL SELECT doc_id, CAST(1000 + i AS VARCHAR), 'unit', CAST(j AS INT), 'Unidad: ' || j || ' de ' || doc_id, CAST(i + 1 AS INT) FROM u
UNION ALL SELECT doc_id, CAST(1000 + i AS VARCHAR), 'loose', 0, 'Un encabezado sin lista', CAST(i + 1 AS INT) FROM m WHERE i < 2
UNION ALL SELECT doc_id, '1002', 'mute', 0, 'Gestión de datos ' || doc_id || ' y sistemas de información', 3 FROM m WHERE i = 2""")
def curriculum_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three modules a document, a page each; the third announces contents and has none."""
    doc = F.col("doc_id").cast("string")
    each = lambda i, f: F.array_join(F.transform(F.sequence(F.lit(0), i), lambda j: f(j.cast("string"))), "")
    outcome = lambda j: F.concat(j, F.lit(". Reconoce "), doc, F.lit(" características\n  del apartado "), j, F.lit(". Criterios de evaluación:\na) Se ha visto la lista de\ncontenidos.\n"))
    unit = lambda j: F.concat(F.lit("Unidad: "), j, F.lit(" de "), doc, F.lit(":\n− Uno. Dos.\n- Tres\n"))

    def module(i):
        head = F.concat(F.lit("Módulo Profesional: Gestión de datos "), doc, F.lit(" y sistemas de \ninformación.\nEquivalencia en créditos: 7\nCódigo: "), (i + 1000).cast("string"), F.lit("\n"))
        body = F.concat(each(i, outcome), F.lit("Contenidos básicos:\n"), each(i, unit), F.lit("Un encabezado sin lista:\nOrientaciones pedagógicas.\nLa función incluye:\n− Nada\n"))
        return F.concat(head, F.when(i < 2, body).otherwise("Contenidos\nno se dan\n"))

    text = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), module), "\f")
    found = curriculum.sections_of(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id")
    return found.select("doc_id", "code", "level", "n", "name", "page")


@query("""WITH q AS (SELECT conv_id, turn, coalesce(length(replace(replace(text, '\\', '\\\\'), '"', '\\"')), 0) + 2 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) - (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) AS c FROM conversations)
SELECT conv_id, turn, 2 AS claims, 1 AS quotes, c::INT AS quote_chars, c::INT AS quote_chars_max FROM q""")
def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and quotes counted in answers that were cut off."""
    quoted = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    raw = F.concat(F.lit('{"afirmaciones": [{"tipo": "cita", "cita" : "'), quoted, F.lit('"}, {"tipo" :"conocimiento", "cita": "sin fin'))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.claims_in(raw).alias("c")).select("conv_id", "turn", "c.*")


@query()
def anchored_premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer against the turn before it, anchored at a piece of that."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).where("role = 'assistant' and before is not null")
    found = evidence.premise_of("before", F.substring("before", 21, 40), "text")
    return rows.select("conv_id", "turn", found.alias("p")).select("conv_id", "turn", "p.route", F.length("p.premise").alias("chars"))


@query()
def turn_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return rows.select("conv_id", "turn", F.round(evidence.likeness("text", "before"), 6).alias("ratio"))


@query("""SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS n FROM documents""")
def numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.numbered(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("""WITH i AS (SELECT vec_id AS a, label AS d, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)
SELECT x.a, arg_min(y.a, (y.i - x.i * 7 % x.n + x.n) % x.n) AS b FROM i x JOIN i y ON x.d <> y.d GROUP BY 1""")
def deterministic_negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.negative_pairs(read(spark, sf_dir, "embeddings"), "vec_id", "label")


@query("""SELECT event_id, user_id, (SELECT max(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase' AND s.ts <= e.ts) AS last_purchase FROM events e""")
def last_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("start"), F.col("ts").alias("last_purchase"))
    return evidence.as_of(e, marks, "user_id", "ts", "start", "last_purchase").select("event_id", "user_id", "last_purchase")


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_mktsegment <> 'BUILDING' THEN 'shifted' WHEN c_acctbal <= 0 THEN 'not_admitted' WHEN c_nationkey = o_orderkey % 25 THEN 'circular' WHEN c_nationkey % 2 <> 0 THEN 'subject' ELSE 'ok' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def gold_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("hash"), (F.col("c_nationkey") % 2).alias("subject_id"), (F.col("c_acctbal") > 0).alias("admitted"), F.col("c_nationkey").cast("long").alias("source_id"))
    gold = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.lit("BUILDING").alias("hash"), F.lit(0).alias("subject_id"), (F.col("o_orderkey") % 25).alias("source_id"))
    return evidence.gold_status(gold, chunks, ["k"]).select("o_orderkey", "status")
