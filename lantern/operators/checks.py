"""Checks of what is loaded, planted and declared, and small relational steps around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import text as X


def every_n_th(df: DataFrame, order: list[str], wanted: int, offset: int = 0) -> DataFrame:
    """About `wanted` rows at even distances of the given order, from `offset` on."""
    from lantern.operators.evidence import numbered

    rows = numbered(df, order, "__n")
    step = F.greatest(F.floor(F.col("__c") / wanted), F.lit(1))
    counted = rows.crossJoin(F.broadcast(df.agg(F.count("*").alias("__c"))))  # one row
    at = F.col("__n") - offset
    return counted.where((at >= 0) & (at % step == 0) & (at / step < wanted)).drop("__n", "__c")


def holds_all(c: Column, needles: list[str]) -> Column:
    """Whether a text holds every needle, case apart."""
    return reduce(lambda a, b: a & b, (F.contains(F.lower(c), F.lit(n.lower())) for n in needles), F.lit(True))


def signed_by(detail: Column, field: str = "$.verificacion.nivel") -> Column:
    """Whether a verdict carries the mark that only one instrument writes: others would confirm themselves."""
    return F.get_json_object(detail, field).isNotNull()


def needs_entailment(kind: Column, verdict: Column) -> Column:
    """Paraphrases, and quotes that turned out not to be literal, go to the entailment check."""
    return F.coalesce((kind == "parafrasis") | (verdict == "degradada_a_parafrasis"), F.lit(False))


def unsigned_reason(kind: Column, verdict: Column, instrument: Column) -> Column:
    """Why a verdict carries no signature: by design, or because it is older than signatures; null if it has one."""
    by_design = kind.isin("conocimiento", "andamiaje") | (verdict == "sin_verificar")
    return F.when(instrument.isNull(), F.when(F.coalesce(by_design, F.lit(False)), "not verifiable").otherwise("undeclared"))


def load_report(loaded: DataFrame, embedded: DataFrame, excluded: DataFrame, subjects: DataFrame, key: list[str], vector: str = "embedding", subject: str = "subject_id", sample: int | None = 1000, close: float = 1e-5) -> DataFrame:
    """check, found, expected, ok: rows loaded are those embedded less those excluded; sampled vectors, matched by key,
    equal the embedded ones; no row without a subject, a vector or a key of its own. The sample is by a hash of the key; None takes all rows."""
    chosen = loaded if sample is None else loaded.orderBy(F.xxhash64(*key), *key).limit(sample)
    pairs = chosen.select(*key, F.col(vector).alias("__a")).join(embedded.select(*key, F.col(vector).alias("__b"), F.lit(True).alias("__there")), key, "left")
    apart = F.coalesce(F.exists(F.zip_with("__a", "__b", lambda a, b: F.abs(a - b) <= close + close * F.abs(b)), lambda x: ~F.coalesce(x, F.lit(False))), F.lit(True))
    counts = [
        ("rows", loaded.agg(F.count("*").alias("found")), embedded.join(excluded, key, "left_anti").agg(F.count("*").alias("expected"))),
        ("vectors that differ", pairs.agg(F.count_if(F.col("__there").isNotNull() & apart).alias("found")), None),
        ("rows never embedded", pairs.agg(F.count_if(F.col("__there").isNull()).alias("found")), None),
        ("rows without a subject", loaded.join(subjects, subject, "left_anti").agg(F.count("*").alias("found")), None),
        ("rows without a vector", loaded.agg(F.count_if(F.col(vector).isNull()).alias("found")), None),
        ("repeated keys", loaded.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("found")), None),
    ]
    rows = []
    for name, found, expected in counts:
        one = found.crossJoin(expected) if expected is not None else found.withColumn("expected", F.lit(0).cast("long"))  # a row each
        rows.append(one.select(F.lit(name).alias("check"), "found", "expected", (F.col("found") == F.col("expected")).alias("ok")))
    return reduce(DataFrame.unionByName, rows)


def counts_agree(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Rows of either side for each value, and whether they agree; values that one side lacks count as 0."""
    a, b = (df.groupBy(by).agg(F.count("*").alias(n)) for df, n in ((left, "n_left"), (right, "n_right")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, by, "full").select(by, zero(F.col("n_left")).alias("n_left"), zero(F.col("n_right")).alias("n_right"), (zero(F.col("n_left")) == zero(F.col("n_right"))).alias("ok"))


def planted_report(planted: DataFrame, declared: DataFrame, path: str = "path", reason: str = "reason") -> DataFrame:
    """path and finding: planted and not declared, declared and not planted, or declared with another reason."""
    p, d = planted.select(path, F.col(reason).alias("__p"), F.lit(True).alias("__is")), declared.select(path, F.col(reason).alias("__d"), F.lit(True).alias("__said"))
    what = F.when(F.col("__said").isNull(), "undeclared").when(F.col("__is").isNull(), "not planted").when(~F.col("__p").eqNullSafe(F.col("__d")), "other reason")
    return p.join(d, path, "full").select(path, what.alias("finding")).where("finding is not null")


def united(**parts: DataFrame) -> DataFrame:
    """Tables of different columns as one, with `origin` naming the table that a row is from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("origin", F.lit(name)) for name, df in parts.items()))


def detection_set(divergent: DataFrame, planted: DataFrame, missed: DataFrame, most: int = 6) -> DataFrame:
    """The cases that conflict detection is measured on: id, origin, code, term, question, expected, documents and detected.

    divergent: code, term and documents, as measured on the glossary. planted and missed: id, code, term, question and document, a row a
    chunk that holds it; cases that are planted, and that are known to be missed today. A case names its first `most` documents.
    """
    one = lambda df, name, seen: df.groupBy(F.concat(F.lit(f"{name}-"), F.col("id").cast("string")).alias("id"), "code", "term", "question").agg(
        F.slice(F.array_sort(F.collect_set("document")), 1, most).alias("documents")
    ).select("id", "code", "term", "question", F.lit("aviso_de_conflicto_con_las_dos_versiones").alias("expected"), "documents", F.lit(seen).alias("detected"))
    name = F.concat(F.lit("glosario-"), F.col("code"), F.lit("-"), F.replace("term", F.lit(" "), F.lit("_")))
    question = F.concat(F.lit("¿Qué es "), F.col("term"), F.lit("?"))
    glossary = divergent.select(name.alias("id"), "code", "term", question.alias("question"), F.lit("aviso_de_definiciones_divergentes").alias("expected"), "documents", F.lit(True).alias("detected"))
    return united(glosario=glossary, plantado=one(planted, "plantado", True), conocido=one(missed, "conocido", False))


def questions(limit: int | None = None, **sets: DataFrame) -> DataFrame:
    """The questions of several evaluation sets, in a stable order: set by set, each by its id; the first `limit` if asked."""
    rows = united(**{name: df.select(F.col("id").cast("string").alias("id"), "question").where(X.collapse(F.col("question")) != "") for name, df in sets.items()})
    place = F.coalesce(*(F.when(F.col("origin") == name, F.lit(i)) for i, name in enumerate(sets)))
    rows = rows.orderBy(place, "id")
    return rows.limit(limit) if limit is not None else rows


def name_discrepancies(names: DataFrame, others: DataFrame, known: DataFrame, key: list[str], name: str = "name") -> DataFrame:
    """Keys whose names differ between two sources though both have one, and whether that is declared already."""
    from lantern.functions.corpus import comparable

    both = names.join(others.select(*key, F.col(name).alias("other")), key).where(comparable(F.col(name)) != comparable(F.col("other")))
    return both.join(known.select(*key, F.lit(True).alias("known")), key, "left").select(*key, name, "other", F.coalesce("known", F.lit(False)).alias("known"))


def layers_differ(layers: dict[str, DataFrame], key: str = "name", value: str = "value") -> DataFrame:
    """Settings of several layers side by side and whether those that set one differ; values of secret names are hidden,
    but only after the comparison."""
    rows = united(**{n: df.select(key, F.regexp_replace(F.trim(F.col(value)), "^[\"']|[\"']$", "").alias(value)) for n, df in layers.items()})
    secret = F.lower(key).rlike("|".join(X.SECRET_NAMES))
    shown = [F.max(F.when(F.col("origin") == n, F.when(secret, "(oculto)").otherwise(F.col(value)))).alias(n) for n in layers]
    differ = F.countDistinct(F.when(F.length(value) > 0, F.col(value))) > 1
    return rows.groupBy(key).agg(*shown, differ.alias("differ"))


def in_bridge(requests: DataFrame, bridge: DataFrame, key: list[str]) -> DataFrame:
    """Each request with whether its pair stands in the bridge; a request that names no pair is fine."""
    named = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key))
    there = bridge.select(*key, F.lit(True).alias("__there")).distinct()
    return requests.join(there, key, "left").withColumn("ok", ~named | F.coalesce("__there", F.lit(False))).drop("__there")


def by_year(subjects: DataFrame, year: str = "year", name: str = "name") -> DataFrame:
    """Subjects in order of year, those without one last, then name."""
    return subjects.orderBy(F.asc_nulls_last(year), name)


def richest(subjects: DataFrame, per: str, size: str = "chunks", id_column: str = "subject_id") -> DataFrame:
    """The subject to begin with where none was asked for: that with most material, ties to the smaller id; none of no material."""
    return subjects.where(F.col(size) > 0).groupBy(per).agg(F.max_by(id_column, F.struct(F.col(size), -F.col(id_column))).alias(id_column), F.count("*").alias("among"))


def strongest(pairs: DataFrame, k: int, score: str = "similarity", tie: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """The k pairs that are most alike, for a stage that costs more."""
    return pairs.orderBy(F.desc(score), *tie).limit(k)


def best_sentence_pair(a: Column, b: Column, first: int = 12) -> Column:
    """The two sentences, of the first of either text, that share most words: a, b and their overlap; null if none share any."""
    cut = lambda c: F.slice(X.sentences(c), 1, first)
    pairs = F.flatten(F.transform(cut(a), lambda x: F.transform(cut(b), lambda y: F.struct(X.jaccard(X.content_words(x), X.content_words(y)).alias("overlap"), x.alias("a"), y.alias("b")))))
    best = F.aggregate(pairs, F.lit(None).cast("struct<overlap:double,a:string,b:string>"), lambda m, p: F.when(m.isNull() | (p["overlap"] > m["overlap"]), p).otherwise(m))
    return F.when(best["overlap"] > 0, best)


def definition_candidates(chunks: DataFrame, subjects: DataFrame, key: str, code: str | None = None, sentence: str = "sentence") -> DataFrame:
    """Chunks with a defining sentence whose subject is known and not left out; of one code only, if asked."""
    rows = chunks.where(X.collapse(F.col(sentence)) != "").join(subjects.where(~F.coalesce(F.col("excluded"), F.lit(False))), key)
    return rows if code is None else rows.where(F.col("code") == code)


def support(claims: DataFrame, response: str, text: str) -> DataFrame:
    """The words that a response's claims bring, which its prose may lean on: their union."""
    words = claims.select(response, F.explode_outer(X.content_words(F.col(text))).alias("w"))
    return words.groupBy(response).agg(F.array_sort(F.collect_set("w")).alias("support"))


def excluded_reason(paths: DataFrame, excluded: DataFrame, path: str = "path") -> DataFrame:
    """Each path with why it is left out by hand, or null; an entry that ends with / leaves out all below it.

    A path is looked up with all folders above it, so the list is joined by equality however long it is.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    rows = paths.select(path, F.posexplode(above).alias("__depth", "__entry")).join(excluded.select(F.col(path).alias("__entry"), "reason"), "__entry")
    found = rows.groupBy(path).agg(F.max_by("reason", "__depth").alias("reason"))
    return paths.join(found, path, "left")


def in_json_array(ids: Column, wanted: Column) -> Column:
    """Whether a JSON array of numbers holds one; what can't be read holds nothing."""
    return F.coalesce(F.array_contains(F.from_json(ids, "array<bigint>"), wanted), F.lit(False))

