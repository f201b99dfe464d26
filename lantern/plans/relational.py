"""Queries of relational shape over the star schema and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.operators import metrics as M
from lantern.operators import reconcile as C

from .registry import query, read


@query("""WITH h AS (SELECT doc_id, source, sha256(text) AS hash FROM documents), m AS (SELECT hash FROM h GROUP BY 1 HAVING count(DISTINCT source) > 1) SELECT doc_id, source, hash FROM h WHERE hash IN (SELECT hash FROM m)""")
def same_content_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.shared_content(read(spark, sf_dir, "documents"), F.col("text"), "source", "doc_id").select("doc_id", "source", "hash")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'same' END AS status FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT count(*) AS orphans FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def orphans_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("orphans"))


@query("""SELECT n.n_name, r.r_name, count(c.c_custkey) AS customers, (SELECT string_agg(x.n_name, ',' ORDER BY x.n_name) FROM nation x WHERE x.n_regionkey = n.n_regionkey AND x.n_nationkey <> n.n_nationkey) AS shared_with
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, r.r_name, n.n_regionkey, n.n_nationkey""")
def catalogue_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, c = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    names = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    counted = C.with_counts(n, c, "n_nationkey", "c_nationkey", "customers")
    others = F.array_join(F.filter("names", lambda x: x != F.col("n_name")), ",")
    return counted.join(names, "n_regionkey").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "customers", F.when(F.size("names") > 1, others).alias("shared_with"))


@query("""SELECT event_type, CASE WHEN value >= 100 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2""")
def verdict_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("value") >= 100, "high").when(F.col("value") >= 50, "medium").otherwise("low")
    return read(spark, sf_dir, "events").groupBy("event_type", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS abstained, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS share FROM events""")
def abstention_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if(F.col("event_type") == "error")
    return read(spark, sf_dir, "events").agg(F.count("*").alias("n"), bad.alias("abstained"), F.round(100.0 * bad / F.count("*"), 4).alias("share"))


@query("""SELECT split_part(url, ':', 1) AS class, substr(split_part(url, ':', 2), 3, 6) AS begins, count(*) AS n FROM pages WHERE contains(url, ':') GROUP BY 1, 2""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the first colon of those addresses that have one, with the beginning of what stands behind it."""
    rows = read(spark, sf_dir, "pages").where(F.contains("url", F.lit(":")))
    part = lambda i: F.split_part("url", F.lit(":"), F.lit(i))
    return rows.groupBy(part(1).alias("class"), F.substring(part(2), 3, 6).alias("begins")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT event_type AS type, CASE WHEN value >= 100 THEN 'verificada' WHEN value >= 50 THEN 'podada' ELSE 'sin_verificar' END AS verdict, CASE WHEN event_id % 3 > 0 THEN 'instrument ' || event_id % 3 END AS instrument FROM events)
SELECT coalesce(instrument, CASE WHEN verdict = 'sin_verificar' THEN 'unsigned: not verifiable' ELSE 'unsigned: undeclared' END) AS signed_by, verdict, count(*) AS n FROM c GROUP BY 1, 2""")
def verdicts_by_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("value") >= 100, "verificada").when(F.col("value") >= 50, "podada").otherwise("sin_verificar")
    signed = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("instrument "), (F.col("event_id") % 3).cast("string")))
    claims = read(spark, sf_dir, "events").select(F.col("event_type").alias("type"), verdict.alias("verdict"), signed.alias("instrument"))
    return M.verdicts_by_instrument(claims)


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS kinds FROM orders GROUP BY 1 HAVING string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) = 'O'""")
def only_one_type_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_sort(F.collect_set("o_orderstatus"))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(kinds.alias("k")).where(F.col("k") == F.array(F.lit("O"))).select("o_custkey", F.array_join("k", ",").alias("kinds"))


@query("""SELECT c_mktsegment, count(*) AS customers, round(avg(n), 6) AS mean_orders, max(n) AS most_orders, round(count(n) / nullif(count(*), 0), 6) AS with_orders
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1""")
def ratio_over_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = read(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    share = F.round(F.count("n") / F.nullif(F.count("*"), F.lit(0).cast("long")), 6)
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.avg("n"), 6).alias("mean_orders"), F.max("n").alias("most_orders"), share.alias("with_orders"))


@query("""SELECT p_type, count(*) AS n, count(DISTINCT lower(p_name)) AS definitions, count(DISTINCT p_brand) AS documents FROM part GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT lower(p_name)) >= 2 AND count(DISTINCT p_brand) >= 2""")
def multi_definition_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.countDistinct(F.lower("p_name")).alias("definitions"), F.countDistinct("p_brand").alias("documents"))
    return p.where("n > 1 AND definitions >= 2 AND documents >= 2")


@query("""SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_cases, round(count(*) / count(DISTINCT user_id), 2) AS factor FROM events GROUP BY 1""")
def two_unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.two_units(read(spark, sf_dir, "events"), ["user_id"], ["event_type"])


@query("""SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(read(spark, sf_dir, "events"), "value", ["event_type"])


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[len(v) // 4 + 1] AS v_4, v[len(v) // 10 + 1] AS v_10 FROM s""")
def index_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.index_quantiles(read(spark, sf_dir, "events"), "value", "event_type")


@query("""SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) FILTER (WHERE json_exists(props, '$.k')) AS with_key, count(*) FILTER (WHERE json_exists(props, '$.absent')) AS without_key FROM events GROUP BY 1""")
def json_path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda k: F.count_if(F.array_contains(F.json_object_keys("props"), k))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), key("k").alias("with_key"), key("absent").alias("without_key"))


@query("""SELECT conv_id, turn, coalesce(string_agg(length(text)::VARCHAR, ',') OVER w, '') AS history FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.history(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.length("text").cast("string"))
    return out.select("conv_id", "turn", F.array_join("history", ",").alias("history"))


@query("""WITH w AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 HOURS PRECEDING AND CURRENT ROW) AS n_window, min(ts) OVER (PARTITION BY user_id) AS begun FROM events),
r AS (SELECT event_id, user_id, ts, n_window, CASE WHEN ts - begun >= INTERVAL 2 HOURS THEN n_window / 7200.0::DOUBLE END AS rate FROM w)
SELECT event_id, user_id, n_window, rate, min(rate) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lowest FROM r""")
def trailing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trailing_rate(read(spark, sf_dir, "events"), "user_id", "ts", 7200).select("event_id", "user_id", "n_window", "rate", "lowest")


@query("""SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000.0::DOUBLE AS ms FROM events""")
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.durations(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "ms")


@query("""WITH t AS (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 150.0])::DOUBLE AS threshold) SELECT threshold, count(value) AS judged, count(*) FILTER (WHERE value < threshold) AS marked, round(count(*) FILTER (WHERE value < threshold) / count(value), 6) AS rate FROM events, t GROUP BY 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sweep(read(spark, sf_dir, "events"), "value", [1, 5, 10, 25, 50, 100, 150])


PLANE = """WITH f AS (SELECT unnest([0.0, 0.25, 0.5])::DOUBLE AS floor), t AS (SELECT unnest([0.02, 0.05, 0.08])::DOUBLE AS threshold),
p AS (SELECT floor, threshold, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity / 50 >= floor AND l_discount >= threshold) AS verified, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity / 50 >= floor AND l_discount < threshold) AS lost,
count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity / 50 < floor) AS below, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity / 50 >= floor AND l_discount >= threshold) AS approved FROM lineitem, f, t GROUP BY 1, 2)"""


def _plane(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("coverage", F.col("l_quantity") / 50)
    return M.calibration_plane(rows, F.col("l_returnflag") == "R", "coverage", "l_discount", [0.0, 0.25, 0.5], [0.02, 0.05, 0.08])


@query(PLANE + " SELECT * FROM p")
def calibration_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane(spark, sf_dir)


@query(PLANE + " SELECT * FROM p ORDER BY CASE WHEN approved > 0 THEN 1 ELSE 0 END, CASE WHEN approved > 0 THEN approved ELSE 0 END, verified DESC, threshold, floor LIMIT 1")
def calibration_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_cell(_plane(spark, sf_dir))


@query("""WITH b AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events) SELECT before, after, count(*) AS n FROM b WHERE before <> after GROUP BY 1, 2""")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.transitions(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS first_signup, count(*) FILTER (WHERE event_type = 'click') AS clicks, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1""")
def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k, v: F.when(F.col("event_type") == k, v)
    errors = F.array_join(F.array_sort(F.collect_list(kind("error", F.col("event_id")))), ",")
    out = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min(kind("signup", F.col("ts"))).alias("first_signup"), F.count(kind("click", 1)).alias("clicks"), errors.alias("errors"))
    return out.withColumn("errors", F.when(F.col("errors") != "", F.col("errors")))


@query("""SELECT o_orderpriority, sum(CAST((o_custkey * 1 + o_orderkey * 3) / 1000000 AS DECIMAL(18, 6)))::DECIMAL(28, 6) AS cost FROM orders GROUP BY 1""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = lambda x: F.lit(x).cast("decimal(6,1)")
    part = M.cost(F.col("o_custkey").cast("decimal(18,0)"), F.col("o_orderkey").cast("decimal(18,0)"), price("1.0"), price("3.0"))
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum(part).cast("decimal(28,6)").alias("cost"))


@query("""SELECT DISTINCT c_mktsegment FROM customer""")
def distinct_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_mktsegment").distinct()


@query("""WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier) SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'left', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'right', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"both": a.intersect(b), "left": a.subtract(b), "right": b.subtract(a), "any": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        df = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = df if out is None else out.unionByName(df)
    return out


@query("""SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS owner, count(*) AS n FROM orders GROUP BY 1""")
def owner_and_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C.owners(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"])
    return o.groupBy("o_custkey").agg(F.max(F.when(F.col("is_owner"), F.col("o_orderkey"))).alias("owner"), F.count("*").alias("n"))


@query("""SELECT coalesce(c.c_custkey, o.o_custkey) AS custkey, coalesce(o.p, c.c_mktsegment) AS class FROM customer c FULL JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""")
def priority_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("class"))
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.min("o_orderpriority").alias("class"))
    return C.overridden([c, o], ["custkey"], ["class"])


@query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n, sha256(text) AS h FROM documents) SELECT a.doc_id AS missing_path, b.doc_id AS found_path FROM (SELECT h, doc_id, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS n FROM r WHERE source < 'src5') a JOIN (SELECT h, doc_id, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS n FROM r WHERE source >= 'src5') b USING (h, n)""")
def hash_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), F.col("doc_id").alias("path"), "source")
    return C.repair(d.where("source < 'src5'"), d.where("source >= 'src5'"), "h", "path")


@query("""WITH m AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), f AS (SELECT c_nationkey, c_mktsegment AS folder FROM m QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1)
SELECT s_suppkey, coalesce(f.folder, 'none') AS inherited FROM supplier LEFT JOIN f ON s_nationkey = c_nationkey""")
def inherited_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    folder = M.first_of(n.withColumn("o", F.struct((-F.col("n")).alias("a"), "c_mktsegment")), ["c_nationkey"], "o").select("c_nationkey", F.col("c_mktsegment").alias("folder"))
    return read(spark, sf_dir, "supplier").join(folder, F.col("s_nationkey") == F.col("c_nationkey"), "left").select("s_suppkey", F.coalesce("folder", F.lit("none")).alias("inherited"))


@query("""SELECT p_name LIKE '%/%' AS a, p_type LIKE 'S%' AND p_type NOT LIKE '%X%' AS b, count(*) AS n FROM part GROUP BY 1, 2""")
def like_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_name").like("%/%").alias("a"), (F.col("p_type").like("S%") & ~F.col("p_type").like("%X%")).alias("b")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    as_of = e.agg(F.max("ts")).first()[0]
    return e.where(F.col("ts") > F.lit(as_of) - F.expr("INTERVAL 7 DAYS")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 50""")
def repeatable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the 50 rows with the smallest seeded hashes."""
    return read(spark, sf_dir, "documents").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7")).cast("binary")), "doc_id").limit(50).select("doc_id", "source")


@query("""SELECT source, lang, count(*) AS n, grouping_id(source, lang)::BIGINT AS level FROM documents GROUP BY CUBE (source, lang)""")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond what is asked: every grouping of two keys."""
    return read(spark, sf_dir, "documents").cube("source", "lang").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four-way chain from a line to what it belongs to."""
    l, o, c, n = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def trace_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"))


@query("""SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_id", "ts")
