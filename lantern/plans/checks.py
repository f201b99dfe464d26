"""Queries of load and manifest checks, evaluation tables, and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import checks as C
from lantern.operators import metrics as M
from lantern.operators import traces as T
from lantern.operators import verify

from .registry import query, read


@query("""WITH n AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS n, count(*) OVER () AS c FROM events) SELECT event_id, event_type FROM n WHERE n >= 3 AND (n - 3) % (c // 20) = 0 AND (n - 3) / (c // 20) < 20""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.every_n_th(read(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 20, 3)


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')""")
def all_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(C.holds_all(F.col("text"), ["The", "License"])).select("doc_id")


# Claims made up from orders: their kind, verdict, and a detail that some instrument signed or not.
CLAIMS = """c AS (SELECT o_orderkey AS claim_id, o_custkey AS response_id, ['literal', 'parafrasis', 'calculo', 'conocimiento', 'andamiaje'][CAST(o_orderkey % 5 + 1 AS INT)] AS type,
['verificada', 'degradada_a_parafrasis', 'podada', 'sin_verificar'][CAST(o_orderkey % 4 + 1 AS INT)] AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN '{"verificacion": {"instrumento": "4.2", "nivel": "espacios", "umbral": 0.9}, "cita": "x"}' ELSE '{"cita": "y"}' END AS detail FROM orders)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*(F.lit(x) for x in names)), (k % n + 1).cast("int"))
    detail = F.when(k % 3 == 0, '{"verificacion": {"instrumento": "4.2", "nivel": "espacios", "umbral": 0.9}, "cita": "x"}').otherwise('{"cita": "y"}')
    return read(spark, sf_dir, "orders").select(
        k.alias("claim_id"), F.col("o_custkey").alias("response_id"), pick(5, "literal", "parafrasis", "calculo", "conocimiento", "andamiaje").alias("type"), F.concat(F.lit("claim "), k).alias("text"),
        k.alias("chunk_id"), pick(4, "verificada", "degradada_a_parafrasis", "podada", "sin_verificar").alias("verdict"), detail.alias("detail"),
    )


@query("WITH " + CLAIMS + """ SELECT claim_id, type = 'parafrasis' OR verdict = 'degradada_a_parafrasis' AS asks, claim_id % 3 = 0 AS signed, CASE WHEN claim_id % 3 = 0 THEN NULL WHEN type IN ('conocimiento', 'andamiaje') OR verdict = 'sin_verificar' THEN 'not verifiable' ELSE 'undeclared' END AS unsigned FROM c""")
def verdict_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.get_json_object("detail", "$.verificacion.instrumento")
    return _claims(spark, sf_dir).select("claim_id", C.needs_entailment(F.col("type"), F.col("verdict")).alias("asks"), C.signed_by(F.col("detail")).alias("signed"), C.unsigned_reason(F.col("type"), F.col("verdict"), signed).alias("unsigned"))


@query("""WITH l AS (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0) SELECT 'rows' AS "check", (SELECT count(*) FROM l) AS found, (SELECT count(*) FROM embeddings WHERE vec_id % 7 <> 0) AS expected, true AS ok
UNION ALL SELECT 'vectors that differ', (SELECT count(*) FROM l WHERE vec_id % 100 = 1), 0, (SELECT count(*) FROM l WHERE vec_id % 100 = 1) = 0 UNION ALL SELECT 'rows never embedded', 0, 0, true
UNION ALL SELECT 'rows without a subject', (SELECT count(*) FROM embeddings WHERE vec_id % 7 <> 0 AND label = 9), 0, (SELECT count(*) FROM embeddings WHERE vec_id % 7 <> 0 AND label = 9) = 0 UNION ALL SELECT 'rows without a vector', 0, 0, true UNION ALL SELECT 'repeated keys', 0, 0, true""")
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that leaves out every seventh vector, spoils some, and has lost a subject."""
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("label", "subject_id")
    spoiled = F.when(F.col("vec_id") % 100 == 1, F.transform("embedding", lambda x: x + 1)).otherwise(F.col("embedding"))
    loaded = e.where("vec_id % 7 != 0").withColumn("embedding", spoiled)
    return C.load_report(loaded, e, e.where("vec_id % 7 = 0").select("vec_id"), e.select("subject_id").where("subject_id != 9").distinct(), ["vec_id"], sample=None)


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, coalesce(a.n, 0) = coalesce(b.n, 0) AS ok FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT n_nationkey AS k, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1) b ON a.k = b.k""")
def counts_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return C.counts_agree(left, read(spark, sf_dir, "nation").where("n_nationkey > 3").select(F.col("n_nationkey").alias("k")), "k")


@query("""WITH p AS (SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0), d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE source END AS source FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM (SELECT coalesce(p.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'undeclared' WHEN p.doc_id IS NULL THEN 'not planted' WHEN p.source <> d.source THEN 'other reason' END AS finding FROM p FULL JOIN d ON p.doc_id = d.doc_id) WHERE finding IS NOT NULL""")
def planted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    declared = docs.where("doc_id % 2 = 0").withColumn("source", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("source")))
    return C.planted_report(docs.where("doc_id % 3 = 0"), declared, "doc_id", "source")


@query("""SELECT * FROM (SELECT CAST(item_id AS VARCHAR) AS id, text AS question, 'benchmark' AS origin FROM benchmark UNION ALL SELECT CAST(conv_id AS VARCHAR), text, 'turns' FROM conversations WHERE turn = 0) WHERE length(trim(question)) > 0 ORDER BY origin = 'turns', id LIMIT 100""")
def question_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred questions of two sets: the limit is part of the report."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    c = read(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("question"))
    return C.questions(100, benchmark=b, turns=c)


@query("""SELECT p_partkey, p_name AS name, other, known FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' nuevo' ELSE upper(p_name) || '.' END AS other, p_partkey % 8 = 0 AS known FROM part) WHERE other LIKE '% nuevo'""")
def name_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    other = p.withColumn("name", F.when(F.col("p_partkey") % 4 == 0, F.concat("name", F.lit(" nuevo"))).otherwise(F.concat(F.upper("name"), F.lit("."))))
    return C.name_discrepancies(p, other, p.where("p_partkey % 8 = 0").select("p_partkey"), ["p_partkey"])


@query("""WITH n AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN n_name || '_API_KEY' ELSE n_name END AS name, n_nationkey AS k FROM nation) SELECT name, CASE WHEN k % 5 = 0 THEN '(oculto)' ELSE k::VARCHAR END AS code,
CASE WHEN k % 5 = 0 THEN '(oculto)' WHEN k % 3 = 0 THEN (k + 1)::VARCHAR ELSE k::VARCHAR END AS live, k % 3 = 0 AS differ FROM n""")
def settings_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = read(spark, sf_dir, "nation").select(F.when(k % 5 == 0, F.concat("n_name", F.lit("_API_KEY"))).otherwise(F.col("n_name")).alias("name"), k.cast("string").alias("value"), k)
    live = n.withColumn("value", F.concat(F.lit('"'), F.when(k % 3 == 0, k + 1).otherwise(k).cast("string"), F.lit('" ')))
    return C.layers_differ({"code": n, "live": live})


@query("""SELECT c_custkey, c_nationkey IS NULL OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = c_custkey % 5) AS ok FROM customer""")
def bridge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 5).cast("int").alias("n_regionkey"))
    bridge = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("int").alias("n_regionkey"))
    return C.in_bridge(asked, bridge, ["n_nationkey", "n_regionkey"]).select("c_custkey", "ok")


@query("""WITH s AS (SELECT label, label % 3 AS degree, count(*) AS chunks FROM embeddings GROUP BY 1) SELECT degree, arg_max(label, (chunks, -label)) AS subject_id, count(*) AS among FROM s GROUP BY 1""")
def richest_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("subject_id")).agg(F.count("*").alias("chunks"))
    return C.richest(s.withColumn("degree", F.col("subject_id") % 3), "degree")


@query("""SELECT n_name, year, CAST(row_number() OVER (ORDER BY year NULLS LAST, n_name) AS INT) AS place FROM (SELECT n_name, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey END AS year FROM nation)""")
def subjects_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places come from a table of subjects, which is small."""
    n = read(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("year"))
    listed = C.by_year(n, "year", "n_name").agg(F.collect_list(F.struct("n_name", "year")).alias("l"))
    return listed.select(F.posexplode("l").alias("p", "s")).select("s.*", (F.col("p") + 1).alias("place"))


@query("""SELECT l_orderkey AS a, l_linenumber AS b, l_extendedprice AS similarity FROM lineitem ORDER BY l_extendedprice DESC, 1, 2 LIMIT 50""")
def strongest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_extendedprice").alias("similarity"))
    return C.strongest(rows, 50)


@query("""WITH d AS (SELECT 'corpus/' || source || '/' || lang || '/' || doc_id AS path, source, lang FROM documents) SELECT path, CASE WHEN lang = 'es' THEN 'by language' WHEN source = 'src3' THEN 'by source' END AS reason FROM d""")
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    paths = d.select(F.concat_ws("/", F.lit("corpus"), "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    entries = d.where("lang = 'es'").select(F.concat(F.lit("corpus/"), "source", F.lit("/es/")).alias("path"), F.lit("by language").alias("reason")).distinct()
    return C.excluded_reason(paths, entries.unionByName(spark.range(1).select(F.lit("corpus/src3/").alias("path"), F.lit("by source").alias("reason"))))


@query("""SELECT event_id, list_contains([CAST(json_extract_string(props, '$.k') AS BIGINT), 3, 5], user_id % 7) AS held FROM events""")
def json_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(", 3, 5]"))
    return read(spark, sf_dir, "events").select("event_id", C.in_json_array(ids, F.col("user_id") % 7).alias("held"))


@query("""SELECT event_type, count(value) AS n, round(median(value), 6) AS median FROM events GROUP BY 1""")
def median_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.median(read(spark, sf_dir, "events"), "value", ["event_type"])


@query("""WITH t AS (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 150.0])::DOUBLE AS threshold), r AS (SELECT threshold, count(*) FILTER (WHERE value < threshold) AS marked FROM events, t GROUP BY 1) SELECT threshold, marked, marked - lag(marked) OVER (ORDER BY threshold) AS gain FROM r""")
def level_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = M.sweep(read(spark, sf_dir, "events"), "value", [1, 5, 10, 25, 50, 100, 150]).select("threshold", "marked")
    return M.level_gains(swept, "threshold", "marked")


@query("""WITH t AS (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 150.0])::DOUBLE AS threshold), r AS (SELECT threshold, count(value) AS judged, count(*) FILTER (WHERE value < threshold) AS marked FROM events, t GROUP BY 1)
SELECT threshold, judged, marked, round(marked / judged, 6) AS rate FROM r WHERE marked / judged <= 0.25 ORDER BY threshold DESC LIMIT 1""")
def sweep_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.highest_admissible(M.sweep(read(spark, sf_dir, "events"), "value", [1, 5, 10, 25, 50, 100, 150]))


@query("""SELECT l_returnflag, count(*) AS occurrences, count(DISTINCT l_linestatus) AS kinds FROM lineitem GROUP BY 1""")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.findings(read(spark, sf_dir, "lineitem"), "l_linestatus", ["l_returnflag"])


@query("""WITH m AS (SELECT sum(length(html))::DOUBLE AS b, sum(length(url))::DOUBLE AS t, count(*)::DOUBLE AS c FROM pages) SELECT round(b / t, 1) AS ratio, round(c / (t / 1048576), 1) AS chunks_per_mb, round(c / (t / 1048576) * (1048576 / (b / t))) AS chunks_per_tb,
round(c / (t / 1048576) * (1048576 / (b / t)) / (c / 100.0) / 3600, 1) AS hours_per_tb, round(c / (t / 1048576) * (1048576 / (b / t)) * 1024 * 4 / 1073741824, 1) AS gb_per_tb FROM m""")
def extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "pages").agg(F.sum(F.length("html")).cast("double").alias("b"), F.sum(F.length("url")).cast("double").alias("t"), F.count("*").cast("double").alias("c"))
    return m.select(*(c.alias(n) for n, c in M.extrapolated(F.col("b"), F.col("t"), F.col("c"), F.lit(100.0)).items()))


@query("""SELECT count(*) AS sentences, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS judged, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS short, round(avg(CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 10) / 10.0 END), 6) AS mean FROM orders""")
def flattened_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of two sentences each, as nested JSON, counted by what was judged and what was too short."""
    k = F.col("o_orderkey")
    one = F.struct(((k % 10) / 10).alias("solape"), (k % 3 == 0).alias("corta"))
    rows = read(spark, sf_dir, "orders").groupBy((k / 2).cast("long").alias("response_id")).agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list(one).alias("frases")).alias("cobertura")).alias("generacion"))).alias("stages"))
    s = M.overlaps(rows, "stages")
    return s.agg(F.count("*").alias("sentences"), F.count_if(~F.col("short")).alias("judged"), F.count_if("short").alias("short"), F.round(F.avg(F.when(~F.col("short"), F.col("overlap"))), 6).alias("mean"))


@query("""SELECT event_type AS level, count(value) AS own_n, round(quantile_cont(value, 0.5), 6) AS own_p50, round(quantile_cont(value, 0.95), 6) AS own_p95, min(value) AS own_low, max(value) AS own_high, round(avg(value), 6) AS own_mean,
count(value) AS total_n, round(quantile_cont(value * 2, 0.5), 6) AS total_p50, round(quantile_cont(value * 2, 0.95), 6) AS total_p95, min(value * 2) AS total_low, max(value * 2) AS total_high, round(avg(value * 2), 6) AS total_mean, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 6) AS degraded FROM events GROUP BY 1""")
def load_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("level"), F.col("value").alias("own"), (F.col("value") * 2).alias("total"))
    return M.load_levels(e, "level", "own", "total", F.col("own") > 100)


@query("""WITH b AS (SELECT user_id, max(value) AS best FROM events GROUP BY 1) SELECT count(*) AS questions, round(max(best), 6) AS highest, round(avg(best), 6) AS mean FROM b""")
def off_corpus_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.off_corpus_baseline(read(spark, sf_dir, "events"), "user_id", "value")


@query("""WITH r AS (SELECT o_custkey, min(o_totalprice) AS low FROM orders GROUP BY 1), m AS (SELECT count(low) AS n, min(low) AS low FROM r), c AS (SELECT unnest([100.0, 300.0, 500.0, 700.0, 900.0, 5000.0])::DOUBLE AS c) SELECT n, low, (SELECT max(c) FROM c WHERE c <= low * (1 - 0.3::DOUBLE)) AS threshold FROM m""")
def rate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("low"))
    return M.rate_threshold(low, "low", [100, 300, 500, 700, 900, 5000])


@query("""SELECT n_nationkey, n_nationkey + (50 - n_nationkey) / 2.0::DOUBLE AS bar FROM nation""")
def decision_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", M.bar(F.col("n_nationkey"), F.lit(50)).alias("bar"))


@query("""SELECT user_id, event_type AS name, CAST(row_number() OVER w AS INT) AS n, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000.0::DOUBLE, 1) AS ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def stage_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stage_marks(read(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


SPANS = """WITH r AS (SELECT o_orderkey, (o_orderkey % 7) * 100.5::DOUBLE AS provider, (o_orderkey % 11) * 200.25::DOUBLE AS prose, 5000.0::DOUBLE AS total, o_orderkey % 50 AS before, o_orderkey % 400 AS tokens FROM orders),
s AS (SELECT o_orderkey, nullif(provider, 0) AS p, nullif(prose, 0) AS q, total, before, nullif(tokens, 0) - nullif(before, 0) AS words FROM r) SELECT o_orderkey, round(p, 1) AS prefill_ms, round(q - p, 1) AS claims_ms, before AS claims_tokens,
CASE WHEN before > 0 AND q - p > 0 THEN round(before / ((q - p) / 1000), 1) END AS claims_rate, round(total - q, 1) AS prose_ms, words AS prose_tokens, CASE WHEN words > 0 AND total - q > 0 THEN round(words / ((total - q) / 1000), 1) END AS prose_rate FROM s"""


@query(SPANS)
def span_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k, ((k % 7) * 100.5).alias("ttft_provider_ms"), ((k % 11) * 200.25).alias("ttft_prose_ms"), F.lit(5000.0).alias("total_ms"), (k % 50).alias("tokens_before_prose"), (k % 400).alias("tokens_total"))
    return T.spans(rows).select("o_orderkey", "prefill_ms", "claims_ms", "claims_tokens", "claims_rate", "prose_ms", "prose_tokens", "prose_rate")


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 9) / 4.0::DOUBLE END AS started, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 9) / 4.0::DOUBLE + 1 END AS ended FROM orders)
SELECT o_orderkey, CASE WHEN ended IS NULL OR ended > 2 THEN CASE WHEN started IS NULL OR started > 0.5 THEN 'saturated' ELSE 'unresponsive' END END AS reason FROM t""")
def give_up_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    begun = (k % 9) / 4
    rows = read(spark, sf_dir, "orders").select(k, F.when(k % 5 != 0, begun).alias("started"), F.when(k % 4 != 0, begun + 1).alias("ended"))
    return rows.select("o_orderkey", T.gave_up(F.lit(0.0), F.col("started"), F.col("ended")).alias("reason"))


@query("WITH " + CLAIMS + """ SELECT claim_id AS id, type AS tipo, 'claim ' || claim_id AS texto, CASE WHEN claim_id % 3 = 0 THEN 'x' ELSE 'y' END AS cita, verdict AS veredicto, CASE WHEN claim_id % 3 = 0 THEN '4.2' END AS instrumento, CASE WHEN claim_id % 3 = 0 THEN '0.9' END AS umbral,
CASE WHEN claim_id % 3 = 0 THEN NULL WHEN type IN ('conocimiento', 'andamiaje') OR verdict = 'sin_verificar' THEN 'not verifiable' ELSE 'undeclared' END AS sin_firma_porque FROM c""")
def public_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _claims(spark, sf_dir).select(T.public_claim().alias("c"), T.public_verdict().alias("v"))
    return both.select("c.id", "c.tipo", "c.texto", "c.cita", "v.veredicto", "v.instrumento", "v.umbral", "v.sin_firma_porque")


@query("""WITH r AS (SELECT c_custkey AS response_id, c_custkey % 3 AS n_context FROM customer), k AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS signed, min(o_orderkey) AS first FROM orders GROUP BY 1)
SELECT response_id, CAST(n_context AS INT) AS n_context, coalesce(n, 0) AS n_claims, coalesce(signed, 0)::BIGINT AS signed, first FROM r LEFT JOIN k ON response_id = o_custkey""")
def trace_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as responses and their orders as claims; of each trace how much was retrieved, claimed and signed."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    requests = c.select(k.alias("request_id"), F.current_timestamp().alias("ts"), F.lit("responder").alias("mode"), F.lit(1).alias("subject_id"), F.lit("?").alias("text"), F.lit("v1").alias("version_prompt"))
    context = F.when(k % 3 == 0, "[]").when(k % 3 == 1, "[7]").otherwise("[7, 8]")
    stages = F.concat(F.lit('{"recuperacion": {"en_contexto": '), context, F.lit(', "construido": true}, "verificacion": {"construido": true}}'))
    responses = c.select(k.alias("response_id"), k.alias("request_id"), F.lit(1).alias("ttft_ms"), F.lit(2).alias("total_ms"), F.lit(3).alias("tokens_in"), F.lit(4).alias("tokens_out"), F.lit(0).alias("cost"), stages.alias("stages"), F.lit(False).alias("abstained"))
    t = T.trace(requests, responses, _claims(spark, sf_dir))
    signed = F.size(F.filter("judged.verdicts", lambda v: v["instrumento"].isNotNull())).cast("long")
    return t.select("response_id", "retrieved.n_context", "claimed.n_claims", signed.alias("signed"), F.try_element_at("claimed.claims", F.lit(1))["id"].alias("first"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS o_orderkey, list_filter([CASE WHEN k % 10 = 0 AND k % 6 <> 0 THEN 'unknown field' END, CASE WHEN k % 7 = 0 THEN 'id' END, CASE WHEN k % 6 = 0 THEN 'type' END, CASE WHEN k % 4 = 0 THEN 'short text' END, CASE WHEN k % 6 <> 0 AND k % 5 = 0 THEN 'chunk' END, CASE WHEN k % 6 <> 0 AND k % 9 = 0 THEN 'quote' END], lambda x: x IS NOT NULL) AS errors FROM o""")
def claim_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal claims made up with every kind of fault, and the faults found."""
    k = F.col("o_orderkey")
    fields = [
        F.when(k % 7 != 0, F.concat(F.lit("a"), k)).otherwise(F.lit(" ")).alias("id"), F.when(k % 6 == 0, "otra").otherwise("literal").alias("tipo"), F.when(k % 4 == 0, "corto").otherwise("un texto largo de sobra").alias("texto"),
        F.when(k % 5 == 0, "5").otherwise(F.concat(F.lit("F"), k)).alias("fragmento_id"), F.when(k % 9 == 0, F.repeat(F.lit("x"), F.lit(121))).otherwise("una cita").alias("cita"), F.when((k % 10 == 0) & (k % 6 != 0), "x").alias("sobra"),
    ]
    claims = read(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(*fields)).alias("c"))
    return claims.select("o_orderkey", verify.claim_errors(F.col("c")).alias("errors"))
