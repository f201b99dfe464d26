"""Queries of names, paths, prose and lexical search over a corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions import calc
from lantern.functions import corpus as C
from lantern.functions import text as X
from lantern.operators import checks, lexical
from lantern.operators import retrieval as R
from lantern.streaming import tokens

from .registry import query, read
from .texts import WORDS

PATHS = """n AS (SELECT doc_id, text, '/' || source || '/Tema ' || (doc_id % 9) || '_Año.' || (CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'docx' END) AS name FROM documents)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("docx")
    name = F.concat(F.lit("/"), "source", F.lit("/Tema "), (F.col("doc_id") % 9).cast("string"), F.lit("_Año."), ending)
    return read(spark, sf_dir, "documents").select("doc_id", "text", name.alias("name"))


@query("WITH " + PATHS + """ SELECT regexp_replace(strip_accents(lower(regexp_replace(name, '\\.[^.]*$', ''))), '[^\\p{L}\\p{N}]', '', 'g') AS key, count(*) AS n FROM n GROUP BY 1""")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).groupBy(C.document_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"))


@query("WITH " + PATHS + """ SELECT doc_id, trim(regexp_replace(replace(replace(strip_accents(lower(name)), '.', ' '), ',', ' '), '\\s+', ' ', 'g')) AS name FROM n""")
def comparable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", C.comparable(F.col("name")).alias("name"))


@query("""SELECT regexp_replace(source || CASE WHEN doc_id % 2 = 0 THEN '-antiguo' ELSE '' END, '-antiguo$', '') AS subject, count(*) AS n FROM documents GROUP BY 1""")
def aliased_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "-antiguo").otherwise(""))
    return read(spark, sf_dir, "documents").groupBy(C.own_subject(name).alias("subject")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, regexp_extract_all(text, '(@\\w+|\\b[a-z]+[A-Z]\\w*\\b|\\b[A-Z][a-z]+[A-Z]\\w*\\b|\\b[a-z_]+_[a-z_]+\\b)') AS found FROM documents""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", C.identifiers(F.col("text")).alias("found"))


@query("""WITH c AS (SELECT conv_id, turn, strip_accents(lower(text)) AS t FROM conversations) SELECT conv_id, turn, contains(t, 'the') AND NOT contains(t, 'license') AS passes, list_filter(['The'], lambda x: NOT contains(t, lower(x))) AS missing, list_filter(['Licénse'], lambda x: contains(t, strip_accents(lower(x)))) AS said FROM c""")
def phrase_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = C.phrase_judgement(F.col("text"), F.array(F.lit("The")), F.array(F.lit("Licénse")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", judged.alias("j")).select("conv_id", "turn", "j.passes", "j.missing", "j.said")


DOUBT = (
    "(?i)(quiz[áa]s?\\s+el\\s+resultado|el\\s+resultado\\s+(que\\s+\\w+\\s+)?(est[áa]|parece|podr[íi]a)\\s*(mal|incorrecto|equivocado)|no\\s+(cuadra|coincide|es\\s+correcto)|revisa\\s+(el|tu)\\s+(resultado|c[áa]lculo)|hay\\s+un\\s+error|no\\s+me\\s+sale\\s+ese"
    "|,\\s*no\\s+(de\\s+|los\\s+|las\\s+|el\\s+|la\\s+)?[0-9.,]+|\\bno\\s+(de\\s+|los\\s+|las\\s+|el\\s+|la\\s+)?[0-9.,]+\\s*(€|euros|horas|minutos|MB/s)?\\s*[.,]|no\\s+es\\s+(suficiente|correcto|el\\s+correcto|lo\\s+correcto)|el\\s+c[áa]lculo\\s+correcto)"
)


@query(f"""WITH a AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Son ' || o_orderkey || ', no ' || (o_orderkey + 1) || '.' WHEN 1 THEN 'El resultado es correcto: ' || o_orderkey WHEN 2 THEN 'Revisa tu cálculo.' WHEN 3 THEN 'no cumple con el máximo de ' || o_orderkey || ' horas, ya que' ELSE 'Así no es suficiente' END AS t FROM orders)
SELECT k AS o_orderkey, regexp_matches(t, '{DOUBT}') AS doubts FROM a""")
def doubtful_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = (
        F.when(k % 5 == 0, F.concat(F.lit("Son "), k, F.lit(", no "), k + 1, F.lit("."))).when(k % 5 == 1, F.concat(F.lit("El resultado es correcto: "), k)).when(k % 5 == 2, "Revisa tu cálculo.")
        .when(k % 5 == 3, F.concat(F.lit("no cumple con el máximo de "), k, F.lit(" horas, ya que"))).otherwise("Así no es suficiente")
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", C.doubts(said).alias("doubts"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'verificada' ELSE 'podada' END AS verdict FROM orders""")
def undeclared_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that stand in prose with their units, half of them wrong by one."""
    k = F.col("o_orderkey")
    said = F.concat(F.lit("Es una igualdad 5 = 5. Quedan "), k, F.lit(" horas - 2 horas = "), k - 2 + k % 2, F.lit(" en total."))
    found = read(spark, sf_dir, "orders").select("o_orderkey", C.undeclared_sum(said).alias("s"))
    return found.select("o_orderkey", calc.calc_verdict("s.expression", "s.result")["verdict"].alias("verdict"))


@query()
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without page numbers, footers and broken bullets."""
    return read(spark, sf_dir, "documents").select("doc_id", C.without_furniture(F.col("text")).alias("text"))


@query()
def file_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that stands before each chunk of a file, of paths made up from the table."""
    path = F.concat_ws("/", F.lit("corpus/daw/curso1"), "source", F.lit("repo/Unidad 1"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")).withColumn("parts", C.path_parts(F.col("path")))
    return rows.select("doc_id", "parts.subject", "parts.unit", C.context_line(F.col("parts"), C.title_of(F.col("path"), F.col("text"))).alias("context"))


@query()
def secrets_and_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", C.secret_or_dump(F.col("text")).alias("secret"), C.looks_like_code(F.col("text")).alias("code"))


@query(f"""WITH w AS (SELECT conv_id, unnest({WORDS.format('text')}) AS w FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id, list_sort(list(DISTINCT w)) AS support FROM w GROUP BY 1)
SELECT c.conv_id, coalesce(support, []) AS support FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant') c LEFT JOIN s ON c.conv_id = s.conv_id""")
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.support(read(spark, sf_dir, "conversations").where("role = 'assistant'"), "conv_id", "text")


@query("""WITH d AS (SELECT doc_id, source, regexp_extract(text, '^[^.]*\\.', 0) AS sentence FROM documents) SELECT doc_id, source, doc_id % 3 AS code FROM d WHERE length(trim(sentence)) > 0 AND source NOT IN ('src3', 'src17')""")
def definition_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_extract("text", r"^[^.]*\.", 0).alias("sentence"), (F.col("doc_id") % 3).alias("code"))
    subjects = read(spark, sf_dir, "documents").select("source", F.col("source").isin("src3", "src17").alias("excluded")).distinct()
    return checks.definition_candidates(d, subjects, "source").select("doc_id", "source", "code")


@query()
def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two sentences that an answer and the turn before it share most words in."""
    rows = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return rows.select("conv_id", "turn", checks.best_sentence_pair(F.col("before"), F.col("text")).alias("p")).select("conv_id", "turn", "p.a", "p.b", F.round("p.overlap", 6).alias("overlap"))


STOPS = "[" + ", ".join(f"'{w}'" for w in lexical.STOP_WORDS) + "]"
TERMS = f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM w), h AS (SELECT * FROM t WHERE NOT list_contains({STOPS}, term))"""


@query("WITH " + TERMS + """, q AS (SELECT doc_id, term, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM h WHERE term IN ('version', 'license') AND doc_id IN (SELECT doc_id FROM h WHERE term = 'version') AND doc_id IN (SELECT doc_id FROM h WHERE term = 'license')),
a AS (SELECT *, max(CASE WHEN term = 'version' THEN pos END) OVER o AS x, max(CASE WHEN term = 'license' THEN pos END) OVER o AS y, max(CASE WHEN term = 'version' THEN n END) OVER o AS i, max(CASE WHEN term = 'license' THEN n END) OVER o AS j FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END AS s, least(i, j) AS m FROM a), c AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM b),
d AS (SELECT doc_id, round(sum(0.1::DOUBLE / (1 + (pos - s) - (n - m))), 6) AS score FROM c WHERE s IS NOT NULL AND (before IS NULL OR s > before) GROUP BY 1) SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM d ORDER BY score DESC, doc_id LIMIT 20""")
def lexical_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "version license", every=True)


@query("WITH " + TERMS + """, s AS (SELECT doc_id, round(0.1::DOUBLE * count(*), 6) AS score FROM h WHERE term IN ('worthless', 'license') AND doc_id NOT IN (SELECT doc_id FROM h WHERE term = 'mit') GROUP BY 1)
SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def lexical_any_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "worthless license -mit")


def _searched(spark, sf_dir, question: str, every: bool = False) -> DataFrame:
    index = lexical.postings(read(spark, sf_dir, "documents"), "doc_id", stemmed=False, only=lexical.terms_of(question, False))
    return lexical.search(index, question, 20, "doc_id", every=every, stemmed=False).select("doc_id", "score", "rank")


PHRASES = TERMS + """, lic AS (SELECT a.doc_id, a.pos AS s, a.pos + 1 AS e FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'license' AND b.term = 'version'),
und AS (SELECT a.doc_id, a.pos AS s, a.pos + 1 AS e FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'licensed' AND b.term = 'under'),
mit AS (SELECT doc_id, pos AS s, pos AS e FROM h WHERE term = 'mit'), apa AS (SELECT doc_id, pos AS s, pos AS e FROM h WHERE term = 'apache')"""


@query("WITH " + PHRASES + """, f AS (SELECT * FROM lic UNION ALL SELECT * FROM und UNION ALL SELECT * FROM mit WHERE doc_id NOT IN (SELECT doc_id FROM h WHERE term = 'der')),
s AS (SELECT doc_id, round(0.1::DOUBLE * count(*), 6) AS score FROM f GROUP BY 1)
SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def lexical_phrase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and words, any of which will do; an alternative's exclusion is its own."""
    return _searched(spark, sf_dir, '"license version" "licensed under" or mit -der')


@query("WITH " + PHRASES + """, two AS (SELECT 1 AS alt, doc_id, s, e, 2 AS n, 0 AS lit FROM und UNION ALL SELECT 1, doc_id, s, e, 1, 1 FROM apa UNION ALL SELECT 0, doc_id, s, e, 1, 0 FROM mit UNION ALL SELECT 0, doc_id, pos, pos, 1, 1 FROM h WHERE term = 'the'),
p AS (SELECT DISTINCT a.alt, a.doc_id, least(a.s, b.s) AS s, greatest(a.e, b.e) AS e FROM two a JOIN two b ON a.alt = b.alt AND a.doc_id = b.doc_id AND a.lit = 0 AND b.lit = 1),
m AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p x WHERE x.alt = p.alt AND x.doc_id = p.doc_id AND x.s >= p.s AND x.e <= p.e AND (x.s, x.e) <> (p.s, p.e))),
c AS (SELECT m.alt, m.doc_id, m.s, m.e, sum(t.n) AS own FROM m JOIN two t ON t.alt = m.alt AND t.doc_id = m.doc_id AND t.s >= m.s AND t.e <= m.e GROUP BY ALL),
s AS (SELECT doc_id, round(sum(0.1::DOUBLE / (1 + e - s + 1 - own)), 6) AS score FROM c WHERE alt = 1 OR doc_id NOT IN (SELECT doc_id FROM lic) GROUP BY 1)
SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def lexical_phrase_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that one of two alternatives asks for, by the closeness in which it stands."""
    return _searched(spark, sf_dir, 'mit the -"license version" or "licensed under" apache', every=True)


@query("WITH " + TERMS + f""", b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark), q AS (SELECT * FROM b WHERE len(w) >= 9),
l AS (SELECT item_id, 0 AS alt, 0 AS lit, false AS out, 0 AS off, w[1] AS term FROM q WHERE w[1] <> 'or' UNION ALL SELECT item_id, 1, 0, false, 0, w[4] FROM q UNION ALL SELECT item_id, 1, 0, false, 1, w[5] FROM q UNION ALL SELECT item_id, 1, 1, true, 0, w[9] FROM q),
k AS (SELECT *, count(*) OVER g AS n, off - min(off) OVER g AS o FROM l WHERE NOT list_contains({STOPS}, term) WINDOW g AS (PARTITION BY item_id, alt, lit)),
names AS (SELECT item_id, alt, lit, string_agg(o || term, ' ' ORDER BY o) AS name FROM k GROUP BY ALL),
x AS (SELECT item_id, alt, lit, out, doc_id, pos - o AS s FROM k JOIN h ON k.term = h.term GROUP BY item_id, alt, lit, out, n, doc_id, s HAVING count(*) = n),
good AS (SELECT * FROM x WHERE NOT out AND (item_id, alt, doc_id) NOT IN (SELECT item_id, alt, doc_id FROM x WHERE out)),
each AS (SELECT DISTINCT item_id, doc_id, name, s FROM good JOIN names USING (item_id, alt, lit)),
s AS (SELECT item_id, doc_id, round(0.1::DOUBLE * count(*), 6) AS score FROM each GROUP BY 1, 2)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 3""")
def lexical_questions_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of questions in one pass over the postings: of each benchmark item a word, or a phrase without another word."""
    w = lexical.words_of(F.col("text"))
    text = F.concat(w[0], F.lit(' or "'), w[3], F.lit(" "), w[4], F.lit('" -'), w[8])
    asked = read(spark, sf_dir, "benchmark").where(F.size(w) >= 9).select("item_id", text.alias("question"))
    index = lexical.postings_for(read(spark, sf_dir, "documents"), asked, "doc_id", stemmed=False)
    return lexical.search_all(index, asked, 3, "doc_id", stemmed=False, query="item_id").select("item_id", "doc_id", "score", "rank")


@query()
def stem_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus that are one to a stemming search."""
    words = read(spark, sf_dir, "documents").select(F.explode(lexical.words_of(F.col("text"))).alias("w"))
    return lexical.collisions(words, "w")


@query("""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || ' ' AS p FROM benchmark) SELECT doc_id, item_id FROM d, b WHERE len(string_split(trim(p), ' ')) >= 5 AND contains(t, p)""")
def passage_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.passage_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id")


RETRIEVED = "WITH " + TERMS + f""", c AS (SELECT doc_id AS chunk_id, doc_id % 7 AS subject_id, CASE WHEN doc_id % 7 < 4 THEN 1 ELSE 2 END AS degree_id, embedding AS e FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
sub AS (SELECT subject_id, degree_id, count(*) AS n FROM c GROUP BY 1, 2), rich AS (SELECT degree_id, arg_max(subject_id, n * 100 - subject_id) AS rich FROM sub GROUP BY 1),
b AS (SELECT item_id, list_slice(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), 1, 6) AS w FROM benchmark),
q AS (SELECT item_id AS query_id, w, item_id % 2 + 1 AS degree_id, CASE WHEN item_id % 3 > 0 THEN CASE item_id % 2 WHEN 0 THEN item_id % 4 ELSE 4 + item_id % 3 END END AS own, CASE WHEN item_id % 5 > 0 THEN embedding END AS v FROM b LEFT JOIN embeddings ON item_id = vec_id),
a AS (SELECT q.*, coalesce(own, rich) AS first FROM q LEFT JOIN rich USING (degree_id)),
words AS (SELECT DISTINCT query_id, unnest(w) AS term FROM a), lit AS (SELECT * FROM words WHERE term <> 'or' AND NOT list_contains({STOPS}, term)),
hit AS (SELECT query_id, doc_id AS chunk_id, round(0.1::DOUBLE * count(*), 6) AS score FROM lit JOIN h USING (term) GROUP BY 1, 2),
pairs AS (SELECT a.query_id, c.chunk_id, c.subject_id = first AS own, v, e FROM a JOIN c ON c.degree_id = a.degree_id),
lex AS (SELECT p.query_id, own, p.chunk_id, row_number() OVER (PARTITION BY p.query_id, own ORDER BY score DESC, p.chunk_id) AS rank FROM pairs p JOIN hit USING (query_id, chunk_id)),
sim AS (SELECT query_id, own, chunk_id, round(list_cosine_similarity(v::DOUBLE[], e::DOUBLE[]), 6) AS score FROM pairs WHERE v IS NOT NULL AND e IS NOT NULL),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, chunk_id) AS rank FROM sim),
l AS (SELECT query_id, own, chunk_id, rank, 'lexical' AS list FROM lex WHERE rank <= 30 UNION ALL SELECT query_id, own, chunk_id, rank, 'vector' FROM vec WHERE rank <= 30),
fus AS (SELECT query_id, own, chunk_id, round(sum(CASE list WHEN 'vector' THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)), 9) AS score, string_agg(list || '#' || rank, '+' ORDER BY list) AS origins FROM l GROUP BY 1, 2, 3),
ran AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, chunk_id) AS INT) AS rank FROM fus),
cf AS (SELECT query_id, own, max(CASE WHEN rank = 1 THEN score END) AS best, arg_max(score, rank) AS last FROM vec WHERE rank <= 6 GROUP BY 1, 2),
lev AS (SELECT query_id, own, CASE WHEN round(best - last, 6) >= 0.085 AND best >= 0.3 THEN 3 WHEN round(best - last, 6) >= 0.025 THEN 2 ELSE 1 END AS level FROM cf),
st AS (SELECT a.query_id, first, v IS NOT NULL AS has_v, coalesce(x.level, 1) AS l1, coalesce(y.level, 1) AS l2, EXISTS (SELECT 1 FROM ran r WHERE r.query_id = a.query_id AND r.own) AS f1, EXISTS (SELECT 1 FROM ran r WHERE r.query_id = a.query_id AND NOT r.own) AS f2
  FROM a LEFT JOIN lev x ON a.query_id = x.query_id AND x.own LEFT JOIN lev y ON a.query_id = y.query_id AND NOT y.own),
fin AS (SELECT *, CASE WHEN has_v THEN l1 = 1 AND f2 AND l2 > l1 ELSE NOT f1 AND f2 END AS adopted FROM st)"""


@query(RETRIEVED + """ SELECT f.query_id, r.chunk_id, r.score, r.origins, r.rank, first AS first_subject, ['low', 'medium', 'high'][CASE WHEN adopted AND has_v THEN l2 ELSE l1 END] AS level, ['low', 'medium', 'high'][l1] AS first_level, adopted
FROM fin f LEFT JOIN ran r ON r.query_id = f.query_id AND r.own = NOT adopted AND r.rank <= 6""")
def retrieved_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's beginnings as questions to the documents, a third of them without a subject, some without a vector."""
    return _retrieved(spark, sf_dir)


def _retrieved(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = read(spark, sf_dir, "documents").join(e, F.col("doc_id") == F.col("vec_id"), "left")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 7).alias("subject_id"), "embedding", "text")
    degree = F.when(F.col("subject_id") < 4, 1).otherwise(2).alias("degree_id")
    subjects = chunks.groupBy("subject_id").agg(F.count("*").alias("chunks")).withColumn("degree_id", degree)
    i = F.col("item_id")
    text = F.array_join(F.slice(lexical.words_of(F.col("text")), 1, 6), " ")
    own = F.when(i % 3 > 0, F.when(i % 2 == 0, i % 4).otherwise(4 + i % 3))
    asked = read(spark, sf_dir, "benchmark").join(e, i == F.col("vec_id"), "left")
    asked = asked.select(i.alias("query_id"), text.alias("question"), (i % 2 + 1).alias("degree_id"), own.alias("subject_id"), F.when(i % 5 > 0, F.col("embedding")).alias("v"))
    index = lexical.postings_for(chunks, asked, "chunk_id", stemmed=False, keep=["subject_id"])
    return R.retrieve_all(chunks, index, asked, subjects, stemmed=False, floor=0.3)


@query(RETRIEVED + """, d AS (SELECT f.query_id, r.rank, '[fragmento_id=F' || r.chunk_id || '] (' || coalesce(source, 'sin unidad') || ')' || chr(10) || text AS p FROM fin f JOIN ran r ON r.query_id = f.query_id AND r.own = NOT adopted AND r.rank <= 6 JOIN documents ON doc_id = r.chunk_id)
SELECT query_id, md5(string_agg(p, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context, count(*) AS n_chunks FROM d WHERE p IS NOT NULL GROUP BY 1""")
def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From words and vectors to the text that a model is given for every question, under real ids."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("unit"), "text")
    found = _retrieved(spark, sf_dir).where("chunk_id is not null").join(d.where("text is not null"), "chunk_id")
    return R.context(found).select("query_id", F.md5("context").alias("context"), "n_chunks")


@F.pandas_udf(T.StringType())
def _prose(answers: pd.Series) -> pd.Series:
    """Reads answers in small pieces, as they would come."""
    out = []
    for a in answers:
        p, text = tokens.Prose("prosa"), ""
        for i in range(0, len(a), 7):
            text += p.feed(a[i : i + 7])
        out.append(text)
    return pd.Series(out)


@query("""SELECT conv_id, turn, text AS prose FROM conversations WHERE text IS NOT NULL""")
def stream_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers packed as JSON with other fields around, and their prose read back piece by piece."""
    c = read(spark, sf_dir, "conversations").where("text is not null")
    answer = F.to_json(F.struct(F.array(F.struct(F.lit("prosa").alias("tipo"))).alias("afirmaciones"), F.col("text").alias("prosa"), F.lit(3).alias("n")))
    return c.select("conv_id", "turn", _prose(answer).alias("prose"))
