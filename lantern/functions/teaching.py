"""What a piece of teaching material is - code, exercise, procedure, worked example, definition, norm, explanation - by rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import text as X

# The patterns of the rules. Flags stand before each: U for words and spaces of all scripts, d for line ends that are \n alone.
DEFINES = (
    r"(?Udi)(?:^|[.:;)\n]\s+)(?:la|el|los|las|un|una|unos|unas)\s+[\wáéíóúñü]{3,}(?:\s+[\wáéíóúñü]{2,}){0,4}\s+(?:es|son)\s+(?:un|una|unos|unas|el|la|los|las|aquell?[oa]s?|cualquier)\b"
    r"|\bse\s+(?:define|definen|denomina|denominan|conoce|conocen)\s+como\b|\bse\s+entiende\s+por\b"
    r"|(?:^|[.:;)\n]\s+)(?:la|el|los|las|un|una)\s+[\wáéíóúñü]{3,}(?:\s+[\wáéíóúñü]{2,}){0,4}\s+consiste\s+en\b"
)
WEAK_GENUS = (
    r"(?Udi)\b(?:es|son)\s+(?:uno|una|unos|unas)\s+de\b|\b(?:es|son)\s+(?:el|la|los|las|lo)\s+que\b"
    r"|\b(?:es|son)\s+(?:el|la|los|las)\s+(?:siguientes?|mismos?|misma|habituales?|anteriores?|de siempre)\b|\bconsiste\s+en\s+que\b|^\s*(?:el|la|los|las|lo)\s+que\b"
)
NO_SENTENCE = r"(?Ud)```|\n\s*[*\-•]\s"
CODE_LINE = (
    r"(?Ud)[{};]\s*$|^\s*[}\]);]|=>|\w+\.\w+\([^)]*\)\s*;"
    r"|^\s*(?:public|private|protected|static|final|abstract|import|package|class|interface|def|function|var|let|const|return|else|using|namespace|#include|@\w+|<\?php)\b"
    r"|^\s*(?:if|for|foreach|while|switch|catch)\s*\(|^\s*(?:print|from\s+\w+\s+import|elif|except|lambda)\b|^\s*\w+\s*=\s*[\"'\[{(]"
)
STEP = r"(?Udim)(?:^|(?<=[.;:])\s)\s*(?:\d{1,2}\s*[.)-]\s+\S|paso\s+\d|primero[,:]|a continuaci[oó]n[,:]|por [uú]ltimo[,:]|luego[,:]|despu[eé]s[,:])"
IMPERATIVE = r"(?Udi)\b(instal[ae]|ejecut[ae]|abr[ea]|escrib[ea]|pulsa|haz clic|crea|configur[ae]|edita|copia|descarga|selecciona|introduce|guarda|reinicia|comprueba|añade|modifica|arranca|accede)\b"
ORDER = (
    r"(?Udm)^\s*(?:[$#>]\s*)?(?:sudo|apt(?:-get)?|yum|dnf|systemctl|service|docker|docker-compose|git|mvn|npm|pip|cd|mkdir|chmod|chown|nano|vim?|useradd|usermod|mysql|psql|tar|wget|curl|ssh|scp|ip|ifconfig|iptables)\s+\S"
)
EXAMPLE = r"(?Udim)^#{1,6}[^\n]*\b(ejemplo|caso pr[aá]ctico|soluci[oó]n|resuelto)\b|^\s*ejemplos?\s*\d*\s*[:.)-]"
MANDATE = (
    r"(?Udim)(?:^|[.\n;:]\s*|\d[.)]\s*)(?:escribe|realiza|crea|implementa|calcula|indica|razona|explica|define|dise[ñn]a|comprueba|responde|contesta|desarrolla|programa|elabora|completa|resuelve|analiza|amplia|entrega|documenta|instala y configura)\b"
)
ASKED = r"(?Udi)\b(se pide|debes|deber[aá]s|tienes que|la misi[oó]n consiste|el objetivo de (?:esta|la) (?:tarea|pr[aá]ctica|actividad))\b"
OPTION = r"(?Udm)^\s*[a-d]\)\s+\S"
TASK_TITLE = r"(?Udi)\b(ejercicios?|tarea|actividad(?:es)?|pr[aá]ctica|test|cuestionario|examen|bolet[ií]n|entrega)\b"
NORM = r"(?Udi)\b(real decreto|orden edu|bolet[ií]n oficial|anexo|resultados de aprendizaje)\b"
KINDS = ("codigo", "enunciado_ejercicio", "procedimiento", "ejemplo_resuelto", "definicion", "normativa", "explicacion")


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def code_share(c: Column) -> Column:
    """Share of code: what stands in fences if there are two or more, else the lines that look like it."""
    pieces = F.split(c, "```")
    fenced = F.aggregate(F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & (i < F.size(pieces) - 1), F.length(p) + 3).otherwise(0)), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"(?U)\S"))
    shown = F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.rlike(CODE_LINE))) / F.size(lines)).otherwise(0.0)
    return F.when(F.size(pieces) >= 3, fenced / F.greatest(F.length(c), F.lit(1))).otherwise(shown)


def defining_sentence(c: Column) -> Column:
    """The first sentence that defines something: an article, a term, its copula and its genus, in six words or more, no
    question, no weak genus such as `es el que`, no fence or list inside. Null if there is none."""
    parts = F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip)
    good = F.filter(parts, lambda s: (n_words(s) >= 6) & ~F.contains(s, F.lit("?")) & ~s.rlike(WEAK_GENUS) & ~s.rlike(NO_SENTENCE) & s.rlike(DEFINES))
    return F.try_element_at(good, F.lit(1))


def is_exercise(c: Column, title: Column) -> Column:
    """What is asked of a student: mandates or options under a title that says so, else more of both."""
    mandates, options, asked = count(c, MANDATE), count(c, OPTION), c.rlike(ASKED)
    titled = F.regexp_replace(F.coalesce(title, F.lit("")), r"[_\-.]+", " ").rlike(TASK_TITLE)
    return F.when(titled, (mandates >= 2) | (options >= 3) | asked).otherwise((options >= 4) | ((mandates >= 3) & asked))


def content_kind(c: Column, title: Column, is_code: Column | None = None) -> Column:
    """One of KINDS, the first that fits; what shows by its form goes before what a word shows. Null is an explanation."""
    c, code = F.coalesce(c, F.lit("")), F.coalesce(is_code, F.lit(False)) if is_code is not None else F.lit(False)
    share, orders = code_share(c), count(c, ORDER)
    defines = (share < 0.2) & (n_words(c) >= 30) & (count(c, r"\?") < 2) & defining_sentence(c).isNotNull()
    return (
        F.when(code | ((share >= 0.5) & (X.whole_sentences(c) <= 2)), KINDS[0])
        .when(is_exercise(c, title), KINDS[1])
        .when(((count(c, STEP) >= 3) & (c.rlike(IMPERATIVE) | (orders > 0))) | (orders >= 3), KINDS[2])
        .when(c.rlike(EXAMPLE), KINDS[3])
        .when(defines, KINDS[4])
        .when(count(c, NORM) >= 2, KINDS[5])
        .otherwise(KINDS[6])
    )


_SIGN = re.compile(r"""\"\"\"|'''|//[^\n]*|/\*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[{}();]""")
_TYPE = re.compile(r"\b(class|interface|enum|record|struct)\s+(\w+)")
_CALL = re.compile(r"(\w+)\s*\((?:[^(){};]|\([^()]*\))*\)\s*(?:throws\s[\w,\s.]+|:\s*[\w<>?\[\], ]+|const|override)?\s*$")
_INDENTED = re.compile(r"(?m)^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)[^\n]*:[ \t]*(?:#[^\n]*)?$")
CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "else", "do", "try", "finally", "synchronized", "using", "lock", "when", "return", "new"}


def braced_blocks(text: str) -> list[tuple[int, int, str, str, int]]:
    """(begin, end, class or method, name, depth) of the declarations that braces hold, by matching brackets outside strings
    and comments. A declaration begins with the line behind what went before it, so annotations and comments are its own.
    Depth counts the declarations around it; a brace that is never closed reaches to the end."""
    out, open_, round_, at, head = [], [], 0, 0, 0
    while m := _SIGN.search(text, at):
        sign, at = m[0], m.end()
        if sign in ('"""', "'''", "/*"):
            end = text.find("*/" if sign == "/*" else sign, at)
            at = len(text) if end < 0 else end + len("*/" if sign == "/*" else sign)
        elif sign == "(":
            round_ += 1
        elif sign == ")":
            round_ = max(0, round_ - 1)
        elif sign == ";" and not round_:
            head = at
        elif sign == "{":
            said = re.sub(r"//[^\n]*|/\*.*?\*/|^[ \t]*@\w+(?:\([^)]*\))?", " ", text[head : m.start()], flags=re.S | re.M)
            kind = name = None
            if (t := _TYPE.search(said)) and not re.search(r"=|:\s*\n", said[t.end() :]):
                kind, name = "class", t[2]
            elif (c := _CALL.search(said)) and c[1] not in CONTROL and "=" not in said[: c.start()] and not re.search(r"\bnew\s*$", said[: c.start()]):
                kind, name = "method", c[1]
            begin = head
            while begin < m.start() and text[begin] in " \t\r\n":
                begin += 1
            line = text.rfind("\n", head, begin) + 1
            open_.append((max(line, head) if line else head if head == 0 else begin, kind, name))
            head, round_ = at, 0
        elif sign == "}":
            if open_:
                begin, kind, name = open_.pop()
                if kind:
                    out.append((begin, at, kind, name, sum(1 for x in open_ if x[1])))
            head, round_ = at, 0
    while open_:
        begin, kind, name = open_.pop()
        if kind:
            out.append((begin, len(text), kind, name, sum(1 for x in open_ if x[1])))
    return sorted(out)


def indented_blocks(text: str) -> list[tuple[int, int, str, str, int]]:
    """The same for declarations whose body is indented: up to the next line that is indented no further; decorators belong
    to the declaration."""
    lines, places, n = [], [], 0
    for line in text.splitlines(keepends=True):
        lines.append(line)
        places.append(n)
        n += len(line)
    where = {p: i for i, p in enumerate(places)}
    width = [len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip()) if x.strip() else None for x in lines]
    out, around = [], []
    for m in _INDENTED.finditer(text):
        i = where[m.start()]
        end = next((k for k in range(i + 1, len(lines)) if width[k] is not None and width[k] <= width[i]), len(lines))
        while end > i + 1 and width[end - 1] is None:
            end -= 1
        first = i
        while first and lines[first - 1].lstrip().startswith("@") and width[first - 1] == width[i]:
            first -= 1
        around = [x for x in around if x > places[i]]
        stop = places[end] if end < len(lines) else len(text)
        out.append((places[first], stop, "class" if m[2] == "class" else "method", m[3], len(around)))
        around.append(stop)
    return out


def code_blocks(text: str) -> list[tuple[int, int, str, str, int]]:
    """Classes and methods of a source text, by braces, or by indentation where braces hold none."""
    return braced_blocks(text) or indented_blocks(text)


_TOKEN = re.compile(r"\w+|[^\w\s]")


def cut_code(text: str, budget: int = 512) -> tuple[list[str], str | None]:
    """Pieces of a source text that begin where a class or a method does, never inside one that fits, and a warning where
    one is larger than the budget. A text that fits, or that holds no place to cut at, stays whole. No overlap; nothing is lost.

    A piece ends at the next place once it has half the budget.
    """
    pieces, warning = _cut(text, budget)
    return [text[a:b] for a, b, _, _, _ in pieces], warning


def _cut(text: str, budget: int) -> tuple[list[tuple[int, int, int, str | None, str | None]], str | None]:
    """Begin, end and tokens of the pieces that cut_code tells of, and what begins there; the text is read for blocks once."""
    n = lambda a, b: len(_TOKEN.findall(text, a, b))
    if not text.strip():
        return [], None
    whole, blocks = n(0, len(text)), code_blocks(text)
    begins = {b: (k, name) for b, _, k, name, _ in reversed(blocks)}
    out, begin, warning = [], 0, None
    if whole > budget:
        for place in sorted(begins)[1:]:
            if (k := n(begin, place)) >= budget // 2:
                out.append((begin, place, k))
                begin = place
        large = sum(k > budget for _, _, k in out) + (n(begin, len(text)) > budget)
        warning = f"{large} pieces over {budget} tokens" if large else None
        if not begins:
            warning = "no class or method to cut at"
    out.append((begin, len(text), n(begin, len(text))))
    return [(a, b, k, *begins.get(a, (None, None))) for a, b, k in out if not text[a:b].isspace()], warning


#: Bytes of source texts that a task cuts at once; or one text.
AT_ONCE = 1 << 20


def code_chunks(documents: DataFrame, id_column: str, text_column: str, budget: int = 512) -> DataFrame:
    """id, ord, text, tokens (words and signs), what begins there (class or method, and its name) and the file's warning, of
    every piece of every source text; null and blank ones have none."""
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64))
            lo = 0
            while lo < len(ends):  # a bounded number of bytes at once, or one text
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
                at, rows = [], []
                for i, text in enumerate(batch.column("text").slice(lo, hi - lo).to_pylist(), lo):
                    pieces, warning = _cut(text or "", budget)
                    at += [i] * len(pieces)
                    rows += [(n, text[a:b], k, what, name, warning) for n, (a, b, k, what, name) in enumerate(pieces)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *columns], names=["id", "ord", "text", "tokens", "kind", "name", "warning"])
                lo = hi

    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    out = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, ord int, text string, tokens int, kind string, name string, warning string")
    return out.withColumnRenamed("id", id_column)
