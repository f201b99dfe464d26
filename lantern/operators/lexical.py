"""Lexical search over stored postings: words or stems with their positions, a query language, cover-density rank."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions import text as X
from lantern.functions.stems import stem, stems
from lantern.operators.retrieval import top
from lantern.session import cut

# Words that the analyser leaves out - forms of four verbs are built from their stems below -, and the weight of one occurrence.
FUNCTION_WORDS = (
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante "
    "todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros "
    "mi mis tú te ti tu tus ellas nosotras vosotros vosotras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas"
).split()
#: Present, other irregular forms; stems of the subjunctive (with e or a), of future, imperfect and preterite.
VERBS = [
    ("estoy estás está estamos estáis están esté estés estemos estéis estén estando estado estada estados estadas estad estaba estabas estábamos estabais estaban", "", "estar", "", "estuv"),
    ("he has ha hemos habéis han habiendo habido habida habidos habidas", "hay", "habr", "hab", "hub"),
    ("soy eres es somos sois son sintiendo sentido sentida sentidos sentidas siente sentid era eras éramos erais eran fui fuiste fue fuimos fuisteis fueron", "se", "ser", "", "fu"),
    ("tengo tienes tiene tenemos tenéis tienen teniendo tenido tenida tenidos tenidas tened", "teng", "tendr", "ten", "tuv"),
]
WEIGHT = 0.1
#: Words that a task looks at together; terms that texts are searched for before they are cut into words; terms of questions that go to all tasks.
WORDS, FEW, TERMS = 500_000, 8, 50_000


def _forms(listed: str, subjunctive: str, future: str, imperfect: str, past: str) -> list[str]:
    i = "" if past == "fu" else "i"
    out = listed.split() + [past + i + e for e in "era eras erais eran ese eses eseis esen".split()] + [past + i + e for e in ("éramos", "ésemos")]
    out += [subjunctive + e for e in "a as amos áis an".split()] * bool(subjunctive)
    out += [future + e for e in "é ás á emos éis án ía ías íamos íais ían".split()]
    out += [imperfect + e for e in "ía ías íamos íais ían".split()] * bool(imperfect)
    return out + [past + e for e in "e iste o imos isteis ieron".split()] * (past != "fu")


STOP_WORDS = [*FUNCTION_WORDS, *dict.fromkeys(w for v in VERBS for w in _forms(*v))]


def words_of(c: Column) -> Column:
    """Runs of letters, digits and underscores, small."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def postings(chunks: DataFrame, id_column: str, text_column: str = "text", stemmed: bool = True, keep: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """term, id, positions (from 1, stop words counted) and n_terms of each chunk; other columns named in `keep` stay, and of
    the terms those in `only`. A chunk's postings are made where it is read; nothing is shuffled.

    Write it partitioned by a hash of the term - `write_postings` does - and a search reads only its terms' files.
    """
    kept, stop, wanted = [id_column, *(keep or [])], frozenset(STOP_WORDS), None if only is None else frozenset(only)
    names = ["term", *kept, "n_terms", "positions"]

    def terms_in(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Of each word: whether it is looked for, and its number among the terms."""
        coded = words.dictionary_encode()
        known: dict[str, int] = {}
        number = []
        for w in coded.dictionary.to_pylist():
            t = None if w is None or w in stop else stem(w) if stemmed else w
            number.append(-1 if t is None or wanted is not None and t not in wanted else known.setdefault(t, len(known)))
        of_word = np.array(number, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        return of_word >= 0, of_word, pa.array(list(known), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__words")
            size = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            ends = np.cumsum(size)
            lo = 0
            while lo < len(size):  # a bounded number of words at once, or one text
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + WORDS, "right")))
                begin = ends[lo:hi] - size[lo:hi] - (ends[lo] - size[lo])
                hit, term, terms = terms_in(column.slice(lo, hi - lo).flatten())
                place = np.flatnonzero(hit)
                row = np.searchsorted(begin, place, "right") - 1
                term = term[place]
                order = np.lexsort((place, term, row))
                place, row, term = place[order], row[order], term[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])[: len(row)])
                positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array((place - begin[row] + 1).astype(np.int32)))
                at = pa.array(lo + row[first], pa.int64())
                own = [batch.column(c).take(at) for c in kept]
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(term[first], pa.int64())), *own, pa.array(size[lo + row[first]].astype(np.int32)), positions], names=names)
                lo = hi

    kinds = [f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in kept]
    if wanted is not None and not stemmed and len(wanted) <= FEW:  # a text that holds none of the terms has no postings
        small = F.lower(text_column)
        chunks = chunks.where(reduce(or_, (F.contains(small, F.lit(w)) for w in sorted(wanted)), F.lit(False)))
    rows = chunks.select(*kept, words_of(F.col(text_column)).alias("__words"))
    return rows.mapInArrow(run, ", ".join(["term string", *kinds, "n_terms int", "positions array<int>"]))


def postings_for(chunks: DataFrame, questions: DataFrame, id_column: str, text_column: str = "text", stemmed: bool = True, keep: list[str] | None = None, question: str = "question") -> DataFrame:
    """The postings that a table of questions needs: those of its terms, or all if it has more than TERMS of them."""
    terms = questions.select(F.explode(asked(stemmed)(F.col(question))).alias("l")).select("l.term").distinct().limit(TERMS + 1).collect()
    return postings(chunks, id_column, text_column, stemmed, keep, None if len(terms) > TERMS else [r[0] for r in terms])


PARTS = 64


def term_part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def write_postings(index: DataFrame, path: str) -> None:
    """Postings in PARTS directories by hash of the term, sorted by term, so that scans prune directories and row groups."""
    rows = index.withColumn("part", term_part(F.col("term")))
    rows.repartition("part", F.pmod(F.xxhash64("term", index.columns[1]), F.lit(8))).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(path)


_UNIT = re.compile(r'((?<!\S)-)?(?:"([^"]*)"?|([^\s"]+))')


def query_tree(question: str, stemmed: bool = True) -> list[list[tuple[bool, tuple[tuple[int, str], ...]]]]:
    """The alternatives that a question joins with a free-standing `or`; each is a list of (excluded, terms with their
    distance from the first).

    Words ask for themselves, words in quotes for that phrase - stop words in it ask for nothing but keep their place -, and
    a hyphen before a word or phrase excludes it. Stop words outside quotes ask for nothing; an alternative that only
    excludes finds nothing and is left out. A quote that is not closed reaches to the end.
    """
    out: list[list] = [[]]
    for excluded, phrase, plain in _UNIT.findall(question.lower()):
        if plain == "or" and not excluded:
            out.append([])
            continue
        words = re.findall(r"\w+", phrase or plain)
        terms = [(i, stem(w) if stemmed else w) for i, w in enumerate(words) if w not in STOP_WORDS]
        if phrase or excluded:
            units = [tuple((i - terms[0][0], t) for i, t in terms)] if terms else []
        else:
            units = [((0, t),) for _, t in terms]
        out[-1] += [(bool(excluded), u) for u in units]
    return [a for a in (list(dict.fromkeys(a)) for a in out) if any(not x for x, _ in a)]


_ASKED = "array<struct<alt:int,lit:int,asks:int,excluded:boolean,phrase:string,terms:int,span:int,at:int,term:string>>"


def asked(stemmed: bool = True):
    """A column function: one row a term of a question, with the alternative and the number of what it asks for there."""

    @F.pandas_udf(_ASKED)
    def rows(questions: pd.Series) -> pd.Series:
        out = []
        for q in questions:
            mine = []
            for alt, units in enumerate(query_tree(q or "", stemmed)):
                asks = sum(not x for x, _ in units)
                lit = 0
                for excluded, terms in units:
                    phrase = " ".join(f"{i}:{t}" for i, t in terms)
                    mine += [dict(alt=alt, lit=-1 if excluded else lit, asks=asks, excluded=excluded, phrase=phrase, terms=len(terms), span=terms[-1][0], at=i, term=t) for i, t in terms]
                    lit += not excluded
            out.append(mine)
        return pd.Series(out)

    return rows


def hits(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of a table of terms; a stored index is read in their directories only."""
    if "part" in index.columns:
        parts = [r[0] for r in terms.select(term_part(F.col("term"))).distinct().collect()]  # PARTS at most
        index = index.where(F.col("part").isin(parts)).drop("part")
    return index.join(terms, "term")


def search_all(
    index: DataFrame, questions: DataFrame, k: int, id_column: str, every: bool = False, stemmed: bool = True, query: str = "query_id", question: str = "question", scope: DataFrame | None = None
) -> DataFrame:
    """The k best chunks of every question: query, id, score and rank. `query_tree` says how questions are read.

    Any (the default): a chunk that holds something that an alternative asks for and nothing that it excludes; WEIGHT for each
    occurrence of a word or phrase. All (`every`): it has to hold everything that an alternative asks for; each shortest
    stretch that does counts WEIGHT, divided by one more than the words in it that weren't asked for, and alternatives add up.
    Ties go to the smaller id. Questions without terms, null ones too, find nothing. `scope` (query and further columns of
    the index) restricts each question, as to subjects. Phrases are found by intersecting their terms' positions, moved to
    where the phrase would begin.
    """
    terms = questions.select(query, F.explode(asked(stemmed)(F.col(question))).alias("l")).select(query, "l.*")
    rows = hits(index, terms)
    if scope is not None:
        rows = rows.join(scope, [c for c in scope.columns if c in rows.columns])
    rows = cut(rows)  # read for words, phrases and exclusions; texts are cut into words but once
    part = [query, "alt", "lit", "asks", "excluded", "phrase", "terms", "span", id_column]
    words = rows.where("terms = 1").select(*part, F.col("positions").alias("starts"))
    parts = rows.where("terms > 1").groupBy(*part).agg(F.collect_list(F.transform("positions", lambda p: p - F.col("at"))).alias("p"))  # a row a term of the phrase
    met = F.aggregate(F.slice("p", 2, F.size("p")), F.col("p")[0], lambda a, x: F.array_intersect(a, x))
    phrases = parts.where(F.size("p") == F.col("terms")).select(*part, met.alias("starts")).where(F.size("starts") > 0)
    found = words.unionByName(phrases)
    one = [query, "alt", id_column]
    good = found.where("not excluded").join(found.where("excluded").select(*one).distinct(), one, "left_anti")
    if not every:
        each = good.groupBy(query, id_column, "phrase").agg(F.max(F.size("starts")).alias("n"))  # once, also if two alternatives ask for it
        scored = each.groupBy(query, id_column).agg(F.round(WEIGHT * F.sum("n"), 6).alias("score"))
        return top(scored, k, "score", id_column, [query])
    most = terms.agg(F.max("asks")).first()[0] or 1  # as many as a question has words
    whole = good.groupBy(*one, "asks").agg(F.count("*").alias("n")).where(F.col("n") == F.col("asks")).select(*one)
    at = good.join(whole, one, "left_semi").select(*one, "lit", "asks", "terms", "span", F.explode("starts").alias("start"))
    w = Window.partitionBy(*one).orderBy("end", F.desc("start"), "lit")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("end", F.col("start") + F.col("span")).withColumn("upto", F.sum("terms").over(so_far))
    # Of each thing asked for the latest occurrence so far; a stretch begins at the earliest of them.
    last = [F.max(F.when(F.col("lit") == i, F.struct("start", (F.col("upto") - F.col("terms")).alias("before")))).over(so_far) for i in range(most)]
    there = sum((F.when(x.isNotNull() | (F.col("asks") <= i), 1).otherwise(0) for i, x in enumerate(last)), F.lit(0))
    first = last[0] if most == 1 else F.least(*last)
    covers = at.withColumn("cover", F.when(there == most, first)).withColumn("previous", F.lag("cover").over(w))
    covers = covers.where(F.col("cover").isNotNull() & (F.col("previous").isNull() | (F.col("cover.start") > F.col("previous.start"))))
    noise = F.greatest(F.col("end") - F.col("cover.start") + 1 - (F.col("upto") - F.col("cover.before")), F.lit(0))
    scored = covers.groupBy(query, id_column).agg(F.round(F.sum(WEIGHT / (1 + noise)), 6).alias("score"))
    return top(scored, k, "score", id_column, [query])


def search(index: DataFrame, question: str, k: int, id_column: str, every: bool = False, stemmed: bool = True) -> DataFrame:
    """search_all for one question: id, score and rank."""
    questions = index.sparkSession.createDataFrame([(0, question)], "query_id int, question string")
    return search_all(index, questions, k, id_column, every, stemmed).drop("query_id")


def terms_of(question: str, stemmed: bool = True) -> list[str]:
    """All terms of a question, for postings of these alone."""
    return sorted({t for a in query_tree(question, stemmed) for _, u in a for _, t in u})


def collisions(words: DataFrame, word: str) -> DataFrame:
    """Stems that several different words share, with the words.

    Each word is stemmed once. Its words are gathered in a list, as before a set Spark leaves `distinct` out.
    """
    one = words.select(F.lower(word).alias("w")).distinct().withColumn("stem", stems(F.array("w"))[0])
    return one.groupBy("stem").agg(F.array_sort(F.collect_list("w")).alias("words")).where(F.size("words") > 1)


def passage_leaks(texts: DataFrame, passages: DataFrame, text_id: str, passage_id: str, text: str = "text", passage: str = "text", least: int = 5) -> DataFrame:
    """(text id, passage id) wherever a text holds a passage of `least` words or more whole, spaces and case apart.

    Runs of `least` words are joined with the passages' first ones by hash, then compared in full.
    """
    flat = lambda c: F.concat(F.lit(" "), X.collapse(F.lower(c)), F.lit(" "))
    p = passages.select(F.col(passage_id).alias("__p"), flat(F.col(passage)).alias("__passage"))
    p = p.withColumn("__w", X.words(F.col("__passage"))).where(F.size("__w") >= least).withColumn("__h", F.xxhash64(F.slice("__w", 1, least))).drop("__w")
    t = texts.select(F.col(text_id).alias("__t"), flat(F.col(text)).alias("__text")).withColumn("__w", X.words(F.col("__text")))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("__w") - least + 1), lambda i: F.xxhash64(F.slice("__w", i, least))))
    t = t.where(F.size("__w") >= least).select("__t", F.explode(runs).alias("__h"))
    # Texts come back only for what agrees in a run.
    near = t.join(p.select("__p", "__h"), "__h").select("__t", "__p").distinct()
    full = texts.select(F.col(text_id).alias("__t"), flat(F.col(text)).alias("__text"))
    both = near.join(p.select("__p", "__passage"), "__p").join(full, "__t")
    return both.where(F.contains("__text", F.col("__passage"))).select(F.col("__t").alias(text_id), F.col("__p").alias(passage_id)).distinct()
