"""Dates of sources, each with where it comes from: own evidence first, then the folder, then what a file was made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.session import cut


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def dated(
    entries: DataFrame,
    norms: list[tuple[str, str]],
    subtrees: list[tuple[str, str, str]],
    mirror: tuple[str, str] = ("corpus/", "corpus/derivado/"),
    rungs: int = 2,
) -> DataFrame:
    """n, path, date and origin of every entry; both are null where nothing tells the date, which isn't invented then.

    entries: n (their order), path (unique), pdf_date, known_date, derived_from and planted_from, all strings. The first
    of these that gives a date counts: a mark of `norms` in the path (`norma`); the document's own metadata, of a PDF
    (`metadatos_pdf`); a prefix of `subtrees`, or its mirror (what stands before the colon of its reason); the date
    that most files of the same folder have by these means, else of the folder above, up to `rungs` of them, ties to the date
    that came first in order (`carpeta`); the date of what the file was derived from or planted after, as far as that had one
    before it in order, else the date it is known to have (`heredada`).
    """
    path, blank = F.col("path"), F.lit(None).cast("string")
    norm = F.coalesce(*(F.when(F.contains(path, F.lit(mark)), F.lit(date)) for mark, date in norms), blank)
    pdf = F.when(F.lower(path).endswith(".pdf") & (F.length("pdf_date") > 0), F.col("pdf_date"))
    under = lambda prefix: path.startswith(prefix) | path.startswith(prefix.replace(*mirror))
    tree = F.coalesce(*(F.when(under(p), F.struct(F.lit(d).alias("date"), F.lit(why.split(":")[0]).alias("origin"))) for p, d, why in subtrees), F.lit(None).cast("struct<date:string,origin:string>"))
    own = F.when(norm.isNotNull(), F.struct(norm.alias("date"), F.lit("norma").alias("origin"))).when(pdf.isNotNull(), F.struct(pdf.alias("date"), F.lit("metadatos_pdf").alias("origin"))).otherwise(tree)
    made_of = F.coalesce(F.when(F.length("derived_from") > 0, F.col("derived_from")), F.when(F.length("planted_from") > 0, F.col("planted_from")))
    rows = cut(entries.select("n", "path", "known_date", made_of.alias("made_of"), own.alias("own")).select("n", "path", "known_date", "made_of", "own.date", "own.origin"))

    votes = rows.where("date is not null").groupBy(folder_of(path).alias("folder"), "date").agg(F.count("*").alias("files"), F.min("n").alias("first"))
    best = votes.groupBy("folder").agg(F.max_by("date", F.struct("files", -F.col("first"))).alias("of_folder"))
    ladder = [folder_of(path)]
    while len(ladder) < rungs:
        ladder.append(folder_of(ladder[-1]))
    open_ = rows.where("date is null")
    near = open_.select("n", F.posexplode(F.array(*ladder)).alias("rung", "folder")).join(best, "folder").groupBy("n").agg(F.min_by("of_folder", "rung").alias("of_folder"))
    rows = rows.join(near, "n", "left").withColumn("origin", F.coalesce("origin", F.when(F.col("of_folder").isNotNull(), "carpeta")))
    rows = rows.select("n", "path", "known_date", "made_of", F.coalesce("date", "of_folder").alias("date"), "origin")
    return _inherited(rows).select("n", "path", "date", "origin")


def _inherited(rows: DataFrame) -> DataFrame:
    """Files without a date take that of what they are made of. A file waits for an origin before it in order that waits too;
    each round settles all whose origin is settled, so there are as many rounds as the longest chain is long."""
    rows = rows.withColumn("settled", F.col("date").isNotNull() | F.col("made_of").isNull())
    while True:
        rows = cut(rows)
        waiting = rows.where("not settled")
        if waiting.isEmpty():
            return rows
        of = rows.select(F.col("path").alias("made_of"), F.col("n").alias("o"), F.col("date").alias("o_date"), F.col("origin").alias("o_origin"), F.col("known_date").alias("o_known"), F.col("settled").alias("o_settled"))
        met = waiting.join(of, "made_of", "left")
        # What was inherited counts from its place in order on; other dates were there before.
        there = F.col("o_date").isNotNull() & ((F.col("o_origin") != "heredada") | (F.col("o") < F.col("n")))
        found = F.when(there, F.col("o_date")).otherwise(F.when(F.length("o_known") > 0, F.col("o_known")))
        ready = F.col("o").isNull() | F.col("o_settled") | (F.col("o") >= F.col("n"))
        date = F.when(ready, found)
        done = met.select("n", "path", "known_date", "made_of", date.alias("date"), F.when(date.isNotNull(), "heredada").alias("origin"), ready.alias("settled"))
        rows = rows.where("settled").unionByName(done)
