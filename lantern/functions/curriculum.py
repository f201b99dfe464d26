"""Modules, outcomes and units out of the text of a curriculum, with pages, and audits of what was not found."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import text as X

# How modules, outcomes, sections of contents and headings of units are written.
GOES_ON = r"[^\n:.\s]"
MODULE = re.compile(
    r"M[oó]dulo\s+[Pp]rofesional:[ \t]*(?P<nombre>[^\n:]{2,89}" + GOES_ON + r"[ \t]*\n[ \t]*(?!(?:Equivalencia|C[oó]digo|Duraci[oó]n|Resultados|Contenidos|M[oó]dulo)\b)[^\n:]{1,60}|[^\n]{3,90})"
    r"[ \t]*\n(?:[^\n]*\n){0,2}?\s*C[oó]digo:\s*(?P<codigo>\d{4})",
    re.M,
)
OUTCOME = re.compile(r"^\s*(\d{1,2})\.\s+(.{15,400}?)\s*Criterios de evaluaci[oó]n:", re.M | re.S)
UNITS = {
    "decree": re.compile(r"^[ \t]*([A-ZÁÉÍÓÚÑ](?:[^\n:]{3,89}" + GOES_ON + r"[ \t]*\n[ \t]*(?![−–\-•])[^\n:]{1,70}|[^\n]{4,90})):[ \t]*\n[ \t]*[−–-]", re.M),
    "order": re.compile(r"^[ \t]*[a-z]\)[ \t]*((?:[^\n:]{4,94}" + GOES_ON + r"[ \t]*\n[ \t]*(?![−–\-•])[^\n:]{1,70}|[^\n]{4,95})):[ \t]*$", re.M),
}
CONTENTS = re.compile(r"^[ \t]*Contenidos(?:\s+b[aá]sicos)?\s*[:.]", re.M)
CONTENTS_LOOSELY = re.compile(r"^[ \t]*Contenidos(?:\s+b[aá]sicos)?[ \t]*[:.]?[ \t]*$", re.I | re.M)
CONTENTS_END = re.compile(r"Orientaciones\s+pedag[oó]gicas|Este m[oó]dulo profesional contiene", re.I)
HEADING_END = re.compile(r"^[ \t]*(?![−–\-•])(?:[a-z]\)[ \t]*)?(?P<t>[^\n]{4,140}):[ \t]*$", re.M)
ORDINALS = ["primero", "segundo", "tercero", "cuarto"]
CODE_LISTED = r"(?m)^\s*(0\d{3})\.?\s+[A-ZÁÉÍÓÚa-z]"
NAME_LISTED = r"(?dm)^[ \t]*(0\d{3})\.?[ \t]+([A-ZÁÉÍÓÚa-z][^\n]{3,120}?)\.?[ \t]*$(?:\n[ \t]*([a-záéíóúñ][^\n]{0,80}?)\.?[ \t]*$)?"
ANNEX = r"(?dm)^\s*ANEXO\s+I\b"
ROW = "code string, level string, n int, name string, page int, begin int, end int"


def _clean(text: str) -> str:
    return " ".join(text.split()).strip(" .")


def sections(text: str, style: str = "decree", page_mark: str = "\f") -> Iterator[tuple]:
    """(code, level, n, name, page, begin, end) of a text whose pages are parted by `page_mark`, in the order in which they stand.

    level: module (begin and end span it whole), outcome, unit, and what the audits find - `mute`, a module that announces
    contents and has no unit, and `loose`, a line of its contents that ends like a heading and is no unit. A name that is
    wrapped to a second line is read whole; units are looked for in the contents only.
    """
    starts = [0, *(m.end() for m in re.finditer(re.escape(page_mark), text))]
    flat = text.replace(page_mark, "\n" * len(page_mark))
    page = lambda at: bisect.bisect_right(starts, at)
    found = list(MODULE.finditer(flat))
    for m, end in zip(found, [*(x.start() for x in found[1:]), len(flat)], strict=False):
        code, body, at = m["codigo"], flat[m.end() : end], m.end()
        yield code, "module", 0, _clean(m["nombre"]), page(m.start()), m.start(), end
        for n, o in enumerate(OUTCOME.finditer(body)):
            yield code, "outcome", n, _clean(o[2]), page(at + o.start(2)), at + o.start(2), at + o.end(2)
        begin = CONTENTS.search(body)
        stop = begin and CONTENTS_END.search(body, begin.end())
        lo, hi = (begin.end(), stop.start() if stop else len(body)) if begin else (0, 0)
        part, names = body[lo:hi], []
        for n, u in enumerate(UNITS[style].finditer(part)):
            names.append(_clean(u[1]))
            yield code, "unit", n, names[-1], page(at + lo + u.start()), at + lo + u.start(1), at + lo + u.end(1)
        if not names and CONTENTS_LOOSELY.search(body):
            yield code, "mute", 0, _clean(m["nombre"]), page(m.start()), m.start(), end
        for n, h in enumerate(x for x in HEADING_END.finditer(part) if not any(_clean(x["t"]) in (c[-len(_clean(x["t"])) :], c) or _clean(x["t"]).endswith(c) for c in names)):
            yield code, "loose", n, _clean(h["t"]), page(at + lo + h.start()), at + lo + h.start("t"), at + lo + h.end("t")


class Sections:
    """The table function: rows of a text, none of a null one."""

    def eval(self, text: str, style: str):
        if text is not None:
            yield from sections(text, style)


def table_function(spark: SparkSession, name: str = "curriculum_sections"):
    """Registers the table function for SQL, and returns it for lateral joins of DataFrames."""
    return spark.udtf.register(name, F.udtf(Sections, returnType=ROW))


def sections_of(documents: DataFrame, id_column: str, text_column: str = "text", style: str = "decree") -> DataFrame:
    """The sections of every document, by a lateral join with the table function."""
    function = F.udtf(Sections, returnType=ROW)
    rows = documents.select(id_column, F.col(text_column).cast("string").alias("__text"))
    return rows.lateralJoin(function(F.col("__text").outer(), F.lit(style))).drop("__text")


def article(text: Column, ordinal: str) -> Column:
    """The part of a decree from an article to the next; null if it isn't there. begin (from 0), end and text."""
    at = lambda o: F.regexp_instr(text, F.lit(rf"Art[ií]culo\s+{o}\."))
    i = ORDINALS.index(ordinal)
    begin, after = at(ordinal) - 1, at(ORDINALS[i + 1]) - 1 if i + 1 < len(ORDINALS) else F.lit(-1)
    end = F.when(after >= 0, after).otherwise(F.length(text))
    return F.when(begin >= 0, F.struct(begin.alias("begin"), end.alias("end"), F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0))).alias("text")))


def before_annex(text: Column) -> Column:
    at = F.regexp_instr(text, F.lit(ANNEX))
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def listed_codes(text: Column) -> Column:
    """Codes of modules that the articles list, before the annex that the sections come from; another place to check against."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(before_annex(text), F.lit(CODE_LISTED), 1)))


def comparable(name: Column) -> Column:
    """A name without accents, capitals and punctuation."""
    return X.collapse(F.translate(X.strip_accents(F.lower(name)), ".,", "  "))


def listed_names(text: Column) -> Column:
    """Map of code to comparable name as the articles give them, the first of a code; names may go on on a second line."""
    region = before_annex(text)
    parts = [F.regexp_extract_all(region, F.lit(NAME_LISTED), i) for i in (1, 2, 3)]
    rows = F.zip_with(parts[0], F.zip_with(parts[1], parts[2], lambda a, b: comparable(F.concat_ws(" ", a, F.when(F.length(b) > 0, b)))), lambda c, n: F.struct(c.alias("c"), n.alias("n")))
    firsts = F.filter(rows, lambda x, i: ~F.exists(F.slice(rows, 1, i), lambda y: y["c"] == x["c"]))
    return F.map_from_entries(firsts)
