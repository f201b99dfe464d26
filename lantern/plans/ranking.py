"""Queries over vectors and rankings. Chunks are the rows of embeddings, subjects their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import vectors as V
from lantern.operators import metrics as M
from lantern.operators import quality as Q
from lantern.operators import retrieval as R

from .registry import query, read

COS = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])))"


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def _first(spark, sf_dir) -> list[float]:
    """The query vector of single-question queries: that of the smallest id."""
    return read(spark, sf_dir, "embeddings").select(F.min_by("embedding", "vec_id")).first()[0]


@query(f"""WITH q AS (SELECT arg_min(embedding, vec_id) AS v FROM embeddings),
s AS (SELECT vec_id, label, round({cos('embedding', 'q.v')}, 6) AS score FROM embeddings, q WHERE label IN (1, 3, 5))
SELECT vec_id, label, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 6""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = R.in_subjects(read(spark, sf_dir, "embeddings"), [1, 3, 5], "label")
    return R.by_vector(chunks, _first(spark, sf_dir), 6, "vec_id").select("vec_id", "label", "score", "rank")


@query(f"""WITH q AS (SELECT arg_min(embedding, vec_id) AS v FROM embeddings),
s AS (SELECT vec_id, label, round({cos('embedding', 'q.v')}, 6) AS score FROM embeddings, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT vec_id, label, score, rank FROM r WHERE rank <= 6""")
def vector_topk_per_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.literal(_first(spark, sf_dir))
    scored = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(V.cosine(F.col("embedding"), q), 6).alias("score"))
    return R.top(scored, 6, "score", "vec_id", ["label"])


# Three lists for a question a subject: its smallest vector's nearest chunks, and two orders of ids that stand for
# the lexical and the glossary list.
LISTS = f"""WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
s AS (SELECT query_id, vec_id, round({cos('embedding', 'v')}, 6) AS score, (vec_id * 7919) % 1009 AS a, (vec_id * 104729) % 997 AS b FROM embeddings JOIN q ON label = query_id),
l AS (SELECT query_id, vec_id AS chunk_id, 'vector' AS list, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
UNION ALL SELECT query_id, vec_id, 'lexical', row_number() OVER (PARTITION BY query_id ORDER BY a DESC, vec_id) FROM s
UNION ALL SELECT query_id, vec_id, 'glossary', row_number() OVER (PARTITION BY query_id ORDER BY b DESC, vec_id) FROM s)"""


def _scored(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    # One row a subject, of which there are few.
    q = F.broadcast(e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("v"), F.min("vec_id").alias("self")))
    return e.join(q, F.col("label") == F.col("query_id")).select("query_id", "self", "vec_id", "label", F.round(V.cosine(F.col("embedding"), F.col("v")), 6).alias("score"))


def _lists(spark, sf_dir, k: int) -> DataFrame:
    s = _scored(spark, sf_dir).withColumns({"a": (F.col("vec_id") * 7919) % 1009, "b": (F.col("vec_id") * 104729) % 997})
    out = None
    for name, by in (("vector", "score"), ("lexical", "a"), ("glossary", "b")):
        part = R.top(s, k, by, "vec_id", ["query_id"]).select("query_id", F.col("vec_id").alias("chunk_id"), F.lit(name).alias("list"), "rank")
        out = part if out is None else out.unionByName(part)
    return out


@query(LISTS + """, f AS (SELECT query_id, chunk_id, round(sum(CASE list WHEN 'vector' THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)), 9) AS score,
string_agg(list || '#' || rank, '+' ORDER BY CASE list WHEN 'lexical' THEN 0 WHEN 'vector' THEN 1 ELSE 2 END) AS origins FROM l WHERE rank <= 30 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM f)
SELECT query_id, chunk_id, score, origins, rank FROM r WHERE rank <= 6""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(_lists(spark, sf_dir, R.POOL), R.CONTEXT)


RANKED = f"""WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS v, min(vec_id) AS self FROM embeddings GROUP BY label),
s AS (SELECT query_id, vec_id, round({cos('embedding', 'v')}, 6) AS score FROM embeddings JOIN q ON label = query_id WHERE vec_id <> self),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""
LEVEL = "CASE WHEN margin >= {high} AND best >= {floor} THEN 'high' WHEN margin >= {medium} THEN 'medium' ELSE 'low' END"


def _ranked(spark, sf_dir, k: int) -> DataFrame:
    s = _scored(spark, sf_dir).where("vec_id <> self")  # copies of the question's vector stay
    return R.top(s, k, "score", "vec_id", ["query_id"])


@query(RANKED + f""", c AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS best, arg_max(score, rank) AS last FROM r WHERE rank <= 6 GROUP BY 1),
m AS (SELECT query_id, best, round(best - last, 6) AS margin FROM c) SELECT query_id, best, margin, {LEVEL.format(high=0.085, medium=0.025, floor=0.3)} AS level FROM m""")
def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.confidence(_ranked(spark, sf_dir, 6), floor=0.3)


@query(f"""WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS v, min(vec_id) AS self FROM embeddings GROUP BY label),
s AS (SELECT query_id, label = query_id AS own, vec_id, round({cos('embedding', 'v')}, 6) AS score FROM embeddings, q WHERE vec_id <> self),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS rank FROM s),
c AS (SELECT query_id, own, max(CASE WHEN rank = 1 THEN score END) AS best, arg_max(score, rank) AS last FROM r WHERE rank <= 6 GROUP BY 1, 2),
m AS (SELECT query_id, own, best, round(best - last, 6) AS margin FROM c),
l AS (SELECT query_id, own, {LEVEL.format(high=0.085, medium=0.025, floor=0.3)} AS level FROM m),
p AS (SELECT a.query_id, a.level AS first_level, b.level AS second_level, list_position(['low', 'medium', 'high'], b.level) > list_position(['low', 'medium', 'high'], a.level) AS adopted FROM l a LEFT JOIN l b ON a.query_id = b.query_id AND NOT b.own WHERE a.own)
SELECT query_id, first_level, second_level, adopted, CASE WHEN adopted THEN second_level ELSE first_level END AS level FROM p""")
def cascade_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    others = R.nearest_chunks(e, _questions(e), 6, "vec_id", subject="label", same=False)
    return R.cascade(R.confidence(_ranked(spark, sf_dir, 6), floor=0.3), R.confidence(others, floor=0.3))


def _questions(e: DataFrame) -> DataFrame:
    """A question a subject: its smallest vector."""
    return e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("v")).withColumn("subject", F.col("query_id"))


# Gold: each subject's second smallest id, to be found by its question's lexical list.
GOLD = LISTS + """, g AS (SELECT label AS query_id, CAST(label % 2 AS INT) AS part, list_sort(list(vec_id))[2] AS chunk_id FROM embeddings GROUP BY label),
p AS (SELECT g.query_id, g.part, r.rank AS position FROM g LEFT JOIN (SELECT * FROM l WHERE list = 'lexical' AND rank <= 30) r ON g.query_id = r.query_id AND g.chunk_id = r.chunk_id)"""


def _positions(spark, sf_dir) -> DataFrame:
    gold = read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("query_id")).agg(F.min("vec_id").alias("m"), F.sort_array(F.collect_set("vec_id"))[1].alias("chunk_id"))
    gold = gold.select("query_id", (F.col("query_id") % 2).cast("int").alias("part"), "chunk_id")
    ranked = _lists(spark, sf_dir, R.POOL).where("list = 'lexical'").select("query_id", "chunk_id", "rank")
    return M.gold_positions(ranked, gold, "query_id", ["chunk_id"])


@query(GOLD + """ SELECT part, count(*) AS n, round(100 * avg(CASE WHEN position <= 6 THEN 1.0 ELSE 0.0 END), 4) AS recall_6, round(100 * avg(CASE WHEN position <= 20 THEN 1.0 ELSE 0.0 END), 4) AS recall_20,
round(avg(CASE WHEN position <= 5 THEN 1 / log2(1 + position) ELSE 0.0 END), 6) AS ndcg_5 FROM p GROUP BY ROLLUP (part)""")
def recall_ndcg_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.recall_table(_positions(spark, sf_dir), "part")


@query(f"""WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
s AS (SELECT query_id, label, vec_id, round({cos('embedding', 'v')}, 6) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
b AS (SELECT query_id, max(CASE WHEN label <> query_id THEN 1 ELSE 0 END) AS bad FROM r WHERE rank <= 6 GROUP BY 1) SELECT count(*) AS n_queries, CAST(sum(bad) AS BIGINT) AS n_contaminated FROM b""")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return M.contaminated(R.nearest_chunks(e, _questions(e), 6, "vec_id", subject="label"), "query_id", "query_id", "label")


@query(f"""SELECT a.label, a.vec_id AS a, b.vec_id AS b, round({cos('a.embedding', 'b.embedding')}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE round({cos('a.embedding', 'b.embedding')}, 6) >= 0.3""")
def near_duplicates_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.similar_pairs(read(spark, sf_dir, "embeddings"), 0.3, "vec_id", "embedding", "label")
    return found.select(F.col("label").cast("int").alias("label"), "a", "b", "similarity")


NEAREST = f"""WITH s AS (SELECT a.vec_id, a.label, b.vec_id AS best_id, b.label AS best_group, round({cos('a.embedding', 'b.embedding')}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label <> b.label),
n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, best_id) = 1)"""


@query(NEAREST + """, c AS (SELECT label, best_group, count(*) AS c FROM n WHERE similarity >= 0.35 GROUP BY 1, 2),
t AS (SELECT label, best_group AS target FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY c DESC, best_group) = 1),
d AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE similarity >= 0.35) AS n_near FROM n GROUP BY 1)
SELECT CAST(d.label AS BIGINT) AS label, d.n, n_near, round(n_near / d.n, 6) AS share, CAST(target AS BIGINT) AS target, n_near / d.n >= 0.1 AS misfiled FROM d LEFT JOIN t ON d.label = t.label""")
def misfiled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nearest = Q.nearest_outside(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return Q.misfiled(nearest, "label", 0.35)


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(['de','la','el','los','las','un','una','y','o','que','en','para','con','por','se','es','son','del','al','como','su','sus'], w)) AS terms FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM t) GROUP BY 1, 2),
h AS (SELECT * FROM p WHERE term IN ('worthless', 'license', 'thntnd')), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
s AS (SELECT doc_id, round(sum(tf * ln(1.0 + (n - df + 0.5) / (df + 0.5))), 6) AS score, count(*) AS n_matched FROM h JOIN df USING (term), n GROUP BY 1)
SELECT doc_id, score, n_matched, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def lexical_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return R.by_words(R.postings(docs, "doc_id", "text"), docs.count(), ["worthless", "license", "thntnd"], 20, "doc_id")


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}0-9]+') AS terms FROM documents)
SELECT count(*) AS n FROM t WHERE list_contains(terms, 'the') AND list_contains(terms, 'and')""")
def lexical_and_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = R.postings(read(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("term").isin("the", "and"))
    return index.groupBy("doc_id").agg(F.count("*").alias("k")).where("k = 2").agg(F.count("*").alias("n"))
