"""Retrieval: lists of candidates by vector, words and glossary, always within named subjects; fusion and confidence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lantern.functions import text as X
from lantern.functions import vectors as V
from lantern.session import cut

# Rank constant, list weights, pool and context sizes, confidence levels.
RANK_CONSTANT = 60
WEIGHTS = {"vector": 10.0, "lexical": 1.0, "glossary": 1.0}
POOL, CONTEXT = 30, 6
HIGH_MARGIN, MEDIUM_MARGIN, LEAST_COSINE = 0.085, 0.025, 0.664


def in_subjects(df: DataFrame, subjects: int | list[int], column: str = "subject_id") -> DataFrame:
    """The mandatory filter. It reaches the scan, and prunes directories where the table is partitioned by subject."""
    subjects = [subjects] if isinstance(subjects, int) else list(subjects or [])
    if not subjects:
        raise ValueError("a subject is needed")
    return df.where(F.col(column).isin(subjects))


def top(df: DataFrame, k: int, score: str, tie: str, per: list[str] | None = None) -> DataFrame:
    """The k best rows with their rank, overall or per group; ties go to the smaller id."""
    order = [F.desc_nulls_last(score), F.asc(tie)]
    if per is None:
        best = df.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("rank") <= k)


def by_vector(chunks: DataFrame, vector: list[float], k: int, id_column: str = "chunk_id", vector_column: str = "embedding") -> DataFrame:
    """Exact nearest chunks of one query vector by cosine, rounded so that equal scores tie."""
    scored = chunks.where(F.col(vector_column).isNotNull()).withColumn("score", F.round(V.cosine(F.col(vector_column), V.literal(vector)), 6))
    return top(scored.drop(vector_column), k, "score", id_column)


#: Queries that are sent to all tasks at once, more take a pass each over the chunks; and those that are multiplied at once.
QUERIES, TILE = 4096, 256


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, by score, then id."""
    order = np.lexsort((ids, -score, row))
    r = row[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r) < k]


def nearest_chunks(chunks: DataFrame, queries: DataFrame, k: int, id_column: str, vector_column: str = "embedding", subject: str = "subject_id", same: bool | None = None) -> DataFrame:
    """query_id, id, subject, score and rank of each query's k nearest chunks by cosine, rounded so that equal scores tie.

    queries: query_id, v and subject, or subjects, an array, within which each query is answered. same: of the query's own
    subject only, of the others only, or of all. Blocks of queries go to all tasks; each keeps the k best of its rows for each
    query, so only these are shuffled. A query that nothing fits has no row; vectors that are null or of another length than
    the block's first take no part.
    """
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in (id_column, subject)}
    rows = chunks.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(subject).alias("subject"), F.col(vector_column).cast("array<double>").alias("v"))
    within = "subjects" in queries.columns

    def scan(block: list):
        names = pa.array([r[0] for r in block], kind)
        q = np.array([r[1] for r in block], float)
        q /= np.maximum(np.sqrt((q * q).sum(axis=1, keepdims=True)), 1e-300)
        asked = [set(r[2] or ()) if within else {r[2]} for r in block]

        def fits(theirs: np.ndarray) -> np.ndarray | None:
            if same is None and not within:
                return None
            kinds, code = np.unique(theirs, return_inverse=True)
            table = np.array([[x in s for x in kinds.tolist()] for s in asked])
            return (table if within or same else ~table)[:, code]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.zeros(0, np.int64), np.zeros(0), None, None]  # query, score, id, subject
            for batch in batches:
                good = np.flatnonzero(batch.column("v").value_lengths().to_numpy() == q.shape[1])
                if not len(good):
                    continue
                batch = batch.take(pa.array(good))
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
                v = (v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)).T
                ids, theirs = batch.column("id").to_numpy(), batch.column("subject").to_numpy(zero_copy_only=False)
                may = fits(theirs)
                for lo in range(0, len(q), TILE):
                    s = np.round(q[lo : lo + TILE] @ v, 6)
                    if may is not None:
                        s[~may[lo : lo + TILE]] = -np.inf
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if s.shape[1] > k else -np.inf
                    row, at = np.nonzero((s >= least) & (s > -np.inf))
                    mine = [row + lo, s[row, at], ids[at], theirs[at]]
                    held = mine if held[2] is None else [np.concatenate(x) for x in zip(held, mine, strict=True)]
                keep = _best(held[0], held[1], held[2], k)
                held = [x[keep] for x in held]
            if held[2] is not None and len(held[0]):
                cols = [names.take(pa.array(held[0])), pa.array(held[2], batch.schema.field("id").type), pa.array(held[3], batch.schema.field("subject").type), pa.array(held[1])]
                yield pa.RecordBatch.from_arrays(cols, names=["query_id", "id", "subject", "score"])

        return run

    out = None
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kinds[id_column]}, subject {kinds[subject]}, score double"
    for block in batched(queries.where("v is not null").select("query_id", "v", "subjects" if within else "subject").orderBy("query_id").toLocalIterator(), QUERIES):
        part = rows.mapInArrow(scan(list(block)), schema)
        out = part if out is None else out.unionByName(part)
    out = chunks.sparkSession.createDataFrame([], schema) if out is None else out
    return top(out, k, "score", "id", ["query_id"]).withColumnsRenamed({"id": id_column, "subject": subject})


def postings(chunks: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Inverted index: term, id, tf and the text's number of terms. Stop words and short words are left out."""
    terms = F.filter(F.regexp_extract_all(F.lower(text_column), F.lit(r"([\p{L}0-9]+)"), 1), lambda w: (F.length(w) > 2) & ~w.isin(X.EMPTY_WORDS))
    return chunks.select(id_column, terms.alias("terms")).select(id_column, F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).groupBy(id_column, "n_terms", "term").agg(F.count("*").alias("tf"))


def by_words(index: DataFrame, n_chunks: int, terms: list[str], k: int, id_column: str, every: bool = False) -> DataFrame:
    """Chunks that hold any of the terms - or all - ranked by the sum of tf times inverse document frequency.

    The terms are few and are pushed to the index's scan; their frequencies come from the same rows.
    """
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.ln(F.lit(1.0) + (F.lit(float(n_chunks)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # One row a term: as many as were asked for.
    scored = hits.join(F.broadcast(df), "term").groupBy(id_column).agg(F.round(F.sum(F.col("tf") * weight), 6).alias("score"), F.count("*").alias("n_matched"))
    if every:
        scored = scored.where(F.col("n_matched") == len(set(terms)))
    return top(scored, k, "score", id_column)


def by_glossary(glossary: DataFrame, question: str, k: int) -> DataFrame:
    """First k distinct chunks of the terms that stand, between spaces, in the question; longer terms first."""
    q = f" {' '.join(question.lower().split())} "
    term = F.concat(F.lit(" "), X.collapse(F.lower("term")), F.lit(" "))
    hits = glossary.where(F.contains(F.lit(q), term)).withColumn("long", F.length("term"))
    best = hits.groupBy("chunk_id").agg(F.max(F.struct("long", F.col("term"))).alias("b")).select("chunk_id", "b.term", "b.long")
    return best.orderBy(F.desc("long"), "term", "chunk_id").limit(k)


def fuse(candidates: DataFrame, k: int, weights: dict[str, float] = WEIGHTS, constant: int = RANK_CONSTANT, query: str = "query_id") -> DataFrame:
    """Reciprocal rank fusion of (query, list, chunk_id, rank): score, and where each chunk came from."""
    weight = F.coalesce(*[F.when(F.col("list") == n, F.lit(w)) for n, w in weights.items()])
    place = F.coalesce(*[F.when(F.col("list") == n, F.lit(i)) for i, n in enumerate(["lexical", "vector", "glossary"])])
    rows = candidates.withColumns({"part": weight / (constant + F.col("rank")), "place": place})
    origins = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "list", "rank"))), lambda x: F.concat(x["list"], F.lit("#"), x["rank"].cast("string"))), "+")
    fused = rows.groupBy(query, "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"), origins.alias("origins"))
    return top(fused, k, "score", "chunk_id", [query])


def level(margin: Column, best: Column, high: float = HIGH_MARGIN, medium: float = MEDIUM_MARGIN, floor: float = LEAST_COSINE) -> Column:
    return F.when((margin >= high) & (best >= floor), "high").when(margin >= medium, "medium").otherwise("low")


def confidence(ranked: DataFrame, query: str = "query_id", k: int = CONTEXT, **levels: float) -> DataFrame:
    """Best score, its distance to the k-th (or last), and the level: rows are (query, rank, score)."""
    found = ranked.where(F.col("rank") <= k).groupBy(query).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max_by("score", "rank").alias("last"))
    margin = F.round(F.col("best") - F.col("last"), 6)
    return found.select(query, "best", margin.alias("margin"), level(margin, F.col("best"), **levels).alias("level"))


def cascade(first: DataFrame, second: DataFrame, query: str = "query_id") -> DataFrame:
    """Takes the wider search only where its confidence is strictly higher."""
    place = lambda c: F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), c)
    both = first.select(query, F.col("level").alias("first_level")).join(second.select(query, F.col("level").alias("second_level")), query, "left")
    better = F.coalesce(place(F.col("second_level")) > place(F.col("first_level")), F.lit(False))
    return both.select(query, "first_level", "second_level", better.alias("adopted"), F.when(better, F.col("second_level")).otherwise(F.col("first_level")).alias("level"))


def rerank(ranked: DataFrame, score: str, query: str = "query_id") -> DataFrame:
    """Order by an outside scorer's column; equal scores keep their order, the score is replaced."""
    w = Window.partitionBy(query).orderBy(F.desc(score), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(w)).drop("rank", "score").withColumnsRenamed({"new_rank": "rank", score: "score"})


def context(ranked: DataFrame, query: str = "query_id", id_column: str = "chunk_id", unit: str = "unit", text: str = "text") -> DataFrame:
    """One text a query: its chunks in order of rank, each under its real id, so that what is cited can be opened."""
    part = F.concat(F.lit("[fragmento_id=F"), F.col(id_column), F.lit("] ("), F.coalesce(unit, F.lit("sin unidad")), F.lit(")\n"), F.col(text))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"])
    return ranked.groupBy(query).agg(F.array_join(parts, "\n\n---\n\n").alias("context"), F.count("*").alias("n_chunks"))


def retrieve(
    chunks: DataFrame,
    index: DataFrame,
    subjects: int | list[int],
    question: str,
    vector: list[float] | None = None,
    glossary: DataFrame | None = None,
    k: int = CONTEXT,
    pool: int = POOL,
    weights: dict[str, float] = WEIGHTS,
    id_column: str = "chunk_id",
    subject: str = "subject_id",
) -> DataFrame:
    """The k best chunks of the subjects for a question: words, vector if there is one, glossary if asked for, fused by rank.

    Columns are chunk_id, score, origins and rank. Without a vector or glossary the others count alone.
    """
    from lantern.operators import lexical

    own = in_subjects(chunks, subjects, subject)
    lists = [("lexical", lexical.search(in_subjects(index, subjects, subject), question, pool, id_column))]
    if vector is not None:
        lists.append(("vector", by_vector(own.select(id_column, "embedding"), vector, pool, id_column)))
    if glossary is not None:
        named = by_glossary(in_subjects(glossary, subjects, subject), question, pool)
        lists.append(("glossary", named.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("long"), "term", "chunk_id")))))  # `pool` rows
    out = None
    for name, df in lists:
        part = df.select(F.lit(0).alias("query_id"), F.lit(name).alias("list"), F.col(id_column).alias("chunk_id"), "rank")
        out = part if out is None else out.unionByName(part)
    return fuse(out, k, weights).drop("query_id")


def confidence_of(found: DataFrame, questions: DataFrame, query: str = "query_id") -> DataFrame:
    """Confidence of every question: one that found nothing is low, with a margin of 0."""
    rows = questions.select(query).distinct().join(found, query, "left")
    return rows.select(query, "best", F.coalesce("margin", F.lit(0.0)).alias("margin"), F.coalesce("level", F.lit("low")).alias("level"))


def by_glossary_all(glossary: DataFrame, questions: DataFrame, scope: DataFrame, k: int, subject: str = "subject_id") -> DataFrame:
    """query_id, chunk_id and rank: each question's first k chunks of the terms that stand in it, between spaces; longer terms
    first, then by term. Terms are met by their first word, so questions and terms are not all compared."""
    flat = lambda c: F.concat(F.lit(" "), X.collapse(F.lower(c)), F.lit(" "))
    q = questions.select("query_id", flat(F.col("question")).alias("__q")).withColumn("__w", F.explode(F.array_distinct(X.words(F.col("__q")))))
    g = glossary.select(subject, "chunk_id", "term", flat(F.col("term")).alias("__t")).withColumn("__w", F.try_element_at(X.words(F.col("__t")), F.lit(1)))
    met = q.join(scope, "query_id").join(g, [subject, "__w"]).where(F.contains("__q", F.col("__t")))
    best = met.groupBy("query_id", "chunk_id").agg(F.max(F.struct(F.length("term").alias("long"), "term")).alias("b"))
    order = Window.partitionBy("query_id").orderBy(F.desc("b.long"), "b.term", "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank")


def retrieve_all(
    chunks: DataFrame,
    index: DataFrame,
    questions: DataFrame,
    subjects: DataFrame,
    glossary: DataFrame | None = None,
    k: int = CONTEXT,
    pool: int = POOL,
    weights: dict[str, float] = WEIGHTS,
    stemmed: bool = True,
    **levels: float,
) -> DataFrame:
    """The whole retrieval of a table of questions: query_id, chunk_id, score, origins, rank, and of the question first_subject,
    level, first_level and adopted. A question that finds nothing has one row without a chunk.

    chunks: chunk_id, subject_id, embedding. index: postings of them with subject_id. questions: query_id, question, degree_id,
    subject_id - null: the subject of the degree with most material, ties to the smaller id - and v, its vector or null. subjects:
    subject_id, degree_id, chunks. Words, vector and glossary give a list each within the subject, which are fused by rank.
    Where the vector list's confidence is low, or without a vector nothing was found, the other subjects of the degree are
    searched, and that counts if its level is strictly higher, or without a vector if it finds anything.
    """
    from lantern.operators import checks, lexical

    rich = checks.richest(subjects, "degree_id").select("degree_id", F.col("subject_id").alias("__rich"))
    asked = questions.join(rich, "degree_id", "left").select("query_id", "question", "degree_id", "v", F.coalesce("subject_id", "__rich").alias("first_subject"))
    asked = cut(asked)

    def one_pass(asked: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The fused list and each question's level; a question without a vector has none."""
        some = scope.groupBy("query_id").agg(F.collect_set("subject_id").alias("subjects"))
        own = nearest_chunks(chunks, asked.join(some, "query_id"), pool, "chunk_id")
        lists = [("lexical", lexical.search_all(index, asked, pool, "chunk_id", stemmed=stemmed, scope=scope)), ("vector", own)]
        if glossary is not None:
            lists.append(("glossary", by_glossary_all(glossary, asked, scope, pool)))
        rows = reduce(DataFrame.unionByName, (df.select("query_id", F.lit(name).alias("list"), "chunk_id", "rank") for name, df in lists))
        level_ = confidence_of(confidence(own, **levels), asked.where("v is not null"))
        return cut(fuse(rows, pool, weights)), cut(level_.select("query_id", "level"))

    found, level_ = one_pass(asked, asked.where("first_subject is not null").select("query_id", F.col("first_subject").alias("subject_id")))
    any_ = found.select("query_id", F.lit(True).alias("__any")).distinct()
    state = asked.join(level_, "query_id", "left").join(any_, "query_id", "left")
    again = cut(state.where("first_subject is not null and (level = 'low' or level is null and __any is null)").drop("__any"))
    scope = again.join(subjects.select("degree_id", "subject_id"), "degree_id").where("subject_id <> first_subject").select("query_id", "subject_id")
    found2, level2 = one_pass(again.drop("level"), scope)
    any2 = found2.select("query_id").distinct().join(level2.select("query_id", F.col("level").alias("__second")), "query_id", "left")
    better = F.col("level").isNull() | F.col("__second").isin("medium", "high")
    taken = again.join(any2, "query_id").where(better).select("query_id", F.coalesce("__second", F.lit("low")).alias("__taken"), F.lit(True).alias("adopted"))
    state = state.drop("__any", "v", "question", "degree_id").join(taken, "query_id", "left")
    state = state.select("query_id", "first_subject", F.coalesce("__taken", "level", F.lit("low")).alias("level"), F.coalesce("level", F.lit("low")).alias("first_level"), F.coalesce("adopted", F.lit(False)).alias("adopted"))
    ranked = found.join(taken, "query_id", "left_anti").unionByName(found2.join(taken, "query_id", "left_semi")).where(F.col("rank") <= k)
    return state.join(ranked, "query_id", "left").select("query_id", "chunk_id", "score", "origins", "rank", "first_subject", "level", "first_level", "adopted")
