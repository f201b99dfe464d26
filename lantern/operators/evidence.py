"""Operators on evidence: premise windows, definitions, content kinds, gold checks, negative pairs and run comparisons."""

from __future__ import annotations

import difflib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions import text as X
from lantern.session import cut

# Sizes of a premise window, usual and widened, in characters.
WINDOW, WIDE = 400, 600
UNRESOLVED = re.compile(r"^\W*(est[aeo]s?|es[aeo]s?|aquell[ao]s?|dich[ao]s?|ell[ao]s?|lo anterior|as[ií])\b", re.I)
IDENTIFIER = re.compile(r"\b(?:[a-z]+[A-Z]\w*|\w+_\w+|[A-Z]{2,}\w*)\b")


def _flat(text: str) -> tuple[str, list[int]]:
    """Lower case without accents, white space collapsed - and the place in the text of each character that is left."""
    out, at = [], []
    for i, c in enumerate(text):
        if c.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                at.append(i)
            continue
        for d in unicodedata.normalize("NFD", c.lower()):
            if unicodedata.category(d) != "Mn":
                out.append(d)
                at.append(i)
    return "".join(out), at


def locate(text: str | None, needle: str | None) -> tuple[int, int] | None:
    """Range of the text that the needle covers, spaces, case and accents apart."""
    flat, at = _flat(text or "")
    want = _flat(needle or "")[0].strip()
    i = flat.find(want) if want else -1
    return (at[i], at[i + len(want) - 1] + 1) if i >= 0 else None


def premise(text: str | None, anchor: str | None, claim: str | None) -> tuple[str | None, str]:
    """The window of whole sentences around the anchor, and how it was found.

    It is widened once if it begins with a word that points back, or if the claim names something that it lacks. Without an
    anchor in the text the sentence that shares most words with the claim stands in.
    """
    text = text or ""
    found = locate(text, anchor)
    cuts = [0, *(m.end() for m in re.finditer(r"(?<=[.!?])\s+|\n+", text)), len(text)]
    if found is None:
        words = set(re.findall(X.WORD, (claim or "").lower()))
        best = max(((len(words & set(re.findall(X.WORD, text[a:b].lower()))), -a, text[a:b].strip()) for a, b in zip(cuts, cuts[1:], strict=False)), default=(0, 0, None))
        return (best[2], "sentence") if best[0] else (None, "none")

    def window(size: int) -> str:
        room = max(0, size - (found[1] - found[0]))
        lo = next((c for c in cuts if c >= found[0] - room // 2 and c <= found[0]), max(0, found[0] - room // 2))
        hi = max((c for c in cuts if found[1] <= c <= max(lo + size, found[1])), default=max(min(len(text), lo + size), found[1]))
        return text[lo:hi].strip()

    out = window(WINDOW)
    unseen = [n for n in IDENTIFIER.findall(claim or "") if n.lower() not in out.lower()]
    return (window(WIDE), "widened") if UNRESOLVED.match(out) or unseen else (out, "window")


@F.pandas_udf(T.StructType([T.StructField("premise", T.StringType()), T.StructField("route", T.StringType())]))
def premise_of(text: pd.Series, anchor: pd.Series, claim: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([premise(*row) for row in zip(text, anchor, claim, strict=True)], columns=["premise", "route"])


class Matcher(difflib.SequenceMatcher):
    """The library's blocks of strings, without junk: runs of four signs are looked for first, then of two, and single signs only
    where no run agrees; of each only the places in the stretch that is searched."""

    def grams(self, n: int) -> dict[str, list[int]]:
        if n == 1:
            return self.b2j
        if n not in (known := self.__dict__.setdefault("_grams", {})):
            known[n] = {}
            for j in range(len(self.b) - n + 1):
                known[n].setdefault(self.b[j : j + n], []).append(j)
        return known[n]

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        a, ahi, bhi = self.a, len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        for n in (4, 2, 1):
            places_of, last, best_i, best_j, best, before = self.grams(n), bhi - n + 1, alo, blo, 0, {}
            for i in range(alo, ahi - n + 1):
                here = {}
                if places := places_of.get(a[i : i + n]):
                    for j in places[bisect_left(places, blo) : bisect_left(places, last)]:
                        k = here[j] = before.get(j - 1, 0) + 1
                        if k > best:
                            best_i, best_j, best = i - k + 1, j - k + 1, k
                before = here
            if best:
                return difflib.Match(best_i, best_j, best + n - 1)
        return difflib.Match(alo, blo, 0)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts."""
    return pd.Series([Matcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def gold_status(gold: DataFrame, chunks: DataFrame, key: list[str], hash_column: str = "hash", subject: str = "subject_id", admitted: str = "admitted", source: str = "source_id") -> DataFrame:
    """Each gold row with what is wrong: missing, shifted, not_admitted, circular, subject - or ok."""
    c = chunks.select(*key, F.col(hash_column).alias("__h"), F.col(subject).alias("__s"), F.col(admitted).alias("__a"), F.col(source).alias("__o"), F.lit(True).alias("__there"))
    status = (
        F.when(F.col("__there").isNull(), "missing")
        .when(~F.col("__h").eqNullSafe(F.col(hash_column)), "shifted")
        .when(~F.coalesce("__a", F.lit(False)), "not_admitted")
        .when(F.col("__o").eqNullSafe(F.col(source)), "circular")
        .when(~F.col("__s").eqNullSafe(F.col(subject)), "subject")
        .otherwise("ok")
    )
    return gold.join(c, key, "left").withColumn("status", status).drop("__h", "__s", "__a", "__o", "__there")


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Rows numbered from 0 in order, without gathering them: ranges are numbered on their own and moved by their offset.

    The ranges are written first: if they were cut twice they could be cut differently.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = cut(ranged.withColumns({"__part": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND((1 << 33) - 1)}))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("c"))
    first = counts.select("__part", (F.sum("c").over(Window.orderBy("__part")) - F.col("c")).alias("f"))  # a row a partition
    return ranged.join(F.broadcast(first), "__part").withColumn(name, F.col("f") + F.col("__in")).drop("__part", "__in", "__at", "f")


def run_ends(rows: DataFrame, place: str, group: str, block: int = 1 << 16) -> DataFrame:
    """Rows numbered from 0 without gaps, with `next`: the first later place at which the group changes, counted on past the last
    row; null if it never does. Places are looked at in blocks, and blocks by their first change, so no task sees all rows. Windows run
    backwards: what reaches to the last row Spark would add up anew for each row."""
    n = rows.count()
    before = rows.select(((F.col(place) + 1) % n).alias(place), F.col(group).alias("__g"))
    begins = F.when(~F.col(group).eqNullSafe(F.col("__g")), F.col(place))
    marked = rows.join(before, place).withColumns({"__begins": begins, "__block": F.floor(F.col(place) / block)}).drop("__g")
    later = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut(marked.groupBy("__block").agg(F.min("__begins").alias("__first")))
    first = firsts.agg(F.min("__first")).first()[0]
    blocks = firsts.select("__block", F.min("__first").over(later).alias("__later"))  # a row a block
    inside = F.min("__begins").over(Window.partitionBy("__block").orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, -1))
    around = F.lit(None if first is None else first + n).cast("long")
    return marked.withColumn("__in", inside).join(blocks, "__block").withColumn("next", F.coalesce("__in", "__later", around)).drop("__begins", "__block", "__in", "__later")


def negative_pairs(rows: DataFrame, id_column: str, document: str, linked: DataFrame | None = None, stride: int = 7) -> DataFrame:
    """For row i of n in id order: the first row from place (i * stride) mod n on that is of another document and not linked.

    Where the row there is of the same document, the search goes on behind that document's run, which is a row of another; where
    it is linked, one place on. So each round settles all rows but those whose next candidate is linked too. Rows that
    nothing fits once around, and empty tables, give no pair.
    """
    base = cut(run_ends(cut(numbered(rows.select(F.col(id_column).alias("a"), F.col(document).alias("d")), ["a"], "i")), "i", "d"))
    n = base.count()
    done = base.select("a", F.col("a").alias("b")).limit(0)
    if not n:
        return done
    at = base.select(F.col("i").alias("j"), F.col("a").alias("b"), F.col("d").alias("e"), "next")
    waiting = cut(base.select("a", "d", (F.col("i") * stride % n).alias("k")).withColumn("begun", F.col("k")))
    while not waiting.isEmpty():
        met = waiting.withColumn("j", F.col("k") % n).join(at, "j")
        same = F.col("e").eqNullSafe(F.col("d")) | (F.col("a") == F.col("b"))
        if linked is not None:
            pairs = linked.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.lit(True).alias("tied")).distinct()
            met = met.join(pairs, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left")
        tied = F.coalesce("tied", F.lit(False)) if linked is not None else F.lit(False)
        met = cut(met.select("a", "b", "d", "k", "begun", "next", "j", same.alias("same"), (~same & ~tied).alias("fits")))
        done = done.unionByName(met.where("fits").select("a", "b"))
        further = F.when(F.col("same"), F.col("k") + F.col("next") - F.col("j")).otherwise(F.col("k") + 1)
        waiting = cut(met.where("not fits").select("a", "d", further.alias("k"), "begun").where(F.col("k") < F.col("begun") + n))
    return done


def run_dispersion(runs: DataFrame, question: str, text: str, claims: str) -> DataFrame:
    """How runs of the same question differ: texts, numbers of claims, and whether anything could vary at all."""
    return runs.groupBy(question).agg(
        F.count("*").alias("runs"),
        F.countDistinct(text).alias("texts"),
        F.countDistinct(F.size(claims)).alias("claim_counts"),
        F.countDistinct(F.array_join(claims, "|")).alias("sequences"),
        (F.max(F.size(claims)) == 0).alias("degenerate"),
    )


def next_pass(attempt: Column, prose_chars: Column, collapsed: Column, elapsed_ms: Column, passes: int = 2, deadline: int = 8000) -> Column:
    """retry or stop: at most two passes, none after prose unless the rate collapsed, none after the deadline."""
    return F.when((attempt >= passes) | (elapsed_ms > deadline) | ((prose_chars > 0) & ~collapsed), "stop").otherwise("retry")


def usage(chars: Column, counted: Column) -> tuple[Column, Column]:
    """Tokens, counted or estimated by characters, and whether they are estimated."""
    return F.coalesce(counted, F.ceil(chars / 3.6)), counted.isNull()


def pdf_date(c: Column) -> Column:
    return F.try_to_date(F.regexp_extract(c, r"D:(\d{8})", 1), "yyyyMMdd")


def retry_after(c: Column, now: Column | None = None, cap: float = 4.0, resets: list[Column] | None = None) -> Column:
    """Seconds to wait, at most `cap`: of a number of seconds, of spans such as `1m30s` and `250ms`, or of an HTTP date, counted
    from `now`. A date that has passed is 0; what can't be read is null, an empty value the longest of `resets` that can
    be read, or null: quotas are independent, so it is no use to come back before the last of them."""
    if resets:
        known = F.array_max(F.array(*(retry_after(r, now, cap) for r in resets)))
        return F.when(F.length(F.coalesce(F.trim(c), F.lit(""))) > 0, retry_after(c, now, cap)).otherwise(known)
    c = F.trim(c)
    parts = F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?(?:ms|s|m|h))"), 1)
    unit = lambda p: F.regexp_extract(p, "[a-z]+$", 0)
    times = lambda p: F.when(unit(p) == "ms", 0.001).when(unit(p) == "s", 1.0).when(unit(p) == "m", 60.0).otherwise(3600.0)
    spans = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.regexp_extract(p, r"^[\d.]+", 0).cast("double") * times(p))
    date = F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    ahead = F.greatest(date.cast("double") - (F.current_timestamp() if now is None else now).cast("double"), F.lit(0.0))
    return (
        F.when(c.rlike(r"^[+-]?\d+(\.\d*)?$"), F.least(F.greatest(c.try_cast("double"), F.lit(0.0)), F.lit(cap)))
        .when(c.rlike(r"^(\d+(\.\d+)?(ms|s|m|h))+$"), F.least(spans, F.lit(cap)))
        .when(c.rlike(r"^[A-Za-z]{3}, \d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} GMT$"), F.when(date.isNotNull(), F.least(ahead, F.lit(cap))))
    )


def as_of(events: DataFrame, marks: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """Each event's last mark at or before it, by one pass over both in order."""
    both = events.withColumns({"__t": F.col(at), "__o": F.lit(1)}).unionByName(marks.select(key, F.col(start).alias("__t"), F.lit(0).alias("__o"), value), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__o = 1").drop("__t", "__o")
