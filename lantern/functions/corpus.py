"""Functions on names, paths and page texts of a corpus, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lantern.functions import text as X
from lantern.functions.teaching import ORDER, strip

# Shapes of page numbers and footers, of identifiers and code, of secrets, and of unit folders; folders that
# only say how material is kept; endings of derived files; ordinals of articles.
PAGE_NUMBER = r"(?i)^\s*[-–—]?\s*(?:p[aá]g(?:ina)?\.?\s*)?\d{1,3}\s*(?:/\s*\d{1,3})?\s*[-–—]?\s*$"
FOOTER = r"(?U)^\s*[\wÁÉÍÓÚÑáéíóúñ][\wÁÉÍÓÚÑáéíóúñ .:ºª]{0,28}?\s*[-–—]\s*\d{1,3}\s*[-–—]\s*$"
GLUED_PAGE = r"(?<=\s)[-–—]\s?\d{1,3}\s?[-–—](?=\s|$)"
IDENTIFIER = r"(?:@\w+|\b[a-z]+[A-Z]\w*\b|\b[A-Z][a-z]+[A-Z]\w*\b|\b[a-z_]+_[a-z_]+\b)"
CODE = r"(?m)[{}]|;\s*$|\w+\s*=\s*\w|&lt;|\b(private|public|protected|import|class|void|return)\b"
PEM = r"-----BEGIN [A-Z ]*(?:KEY|CERTIFICATE)-----"
UNIT = r"(?i)^(unidad|tema|ud|ut|bloque|m[oó]dulo|cap[ií]tulo)[ _.-]*\d"
STORAGE_FOLDERS = (
    "apuntes material materiales documentos documentacion docs doc teoria practicas practica ejercicios ejercicio src img imagenes images manuales manual guias guia "
    "recursos varios otros temario pdf pdfs java python php sql csharp netcore springboot models views controllers test tests examen examenes tareas trabajos resumen "
    "code assets css js data files notas anexos presentaciones videos"
).split()
ENDINGS = r"(?i)(\.pdf\.md|\.odt\.md|\.docx\.md|\.md|\.markdown|\.txt|\.html|\.htm)$"
ORDINALS = ["primero", "segundo", "tercero", "cuarto"]
DOUBT = (
    r"(?i)(quiz[áa]s?\s+el\s+resultado|el\s+resultado\s+(que\s+\w+\s+)?(est[áa]|parece|podr[íi]a)\s*(mal|incorrecto|equivocado)|no\s+(cuadra|coincide|es\s+correcto)"
    r"|revisa\s+(el|tu)\s+(resultado|c[áa]lculo)|hay\s+un\s+error|no\s+me\s+sale\s+ese|,\s*no\s+(?:de\s+|los\s+|las\s+|el\s+|la\s+)?[\d.,]+"
    r"|\bno\s+(?:de\s+|los\s+|las\s+|el\s+|la\s+)?[\d.,]+\s*(€|euros|horas|minutos|MB/s)?\s*[.,]|no\s+es\s+(suficiente|correcto|el\s+correcto|lo\s+correcto)|el\s+c[áa]lculo\s+correcto)"
)


def document_key(name: Column) -> Column:
    """Letters and digits of a file's name without its ending, small and without accents: versions of a document share it."""
    return F.regexp_replace(X.strip_accents(F.lower(F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""))), r"[^\p{L}\p{N}]", "")


def comparable(name: Column) -> Column:
    """A name small, without accents, points, commas and spare spaces."""
    return X.collapse(F.translate(X.strip_accents(F.lower(name)), ".,", "  "))


def own_subject(name: Column) -> Column:
    """An old version of a subject is the subject."""
    return F.regexp_replace(name, "-antiguo$", "")


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IDENTIFIER), 0)


def looks_like_code(c: Column) -> Column:
    return c.rlike(CODE)


def doubts(c: Column) -> Column:
    """Whether an answer calls the result that it was given into doubt."""
    return c.rlike(DOUBT)


def phrase_judgement(c: Column, required: Column, forbidden: Column) -> Column:
    """passes, missing and said: which required phrases a text lacks and which forbidden ones it has, case and accents apart."""
    flat = lambda x: X.strip_accents(F.lower(F.coalesce(x, F.lit(""))))
    text, none = flat(c), F.array().cast("array<string>")
    missing = F.filter(F.coalesce(required, none), lambda p: ~F.contains(text, flat(p)))
    said = F.filter(F.coalesce(forbidden, none), lambda p: F.contains(text, flat(p)))
    return F.struct(((F.size(missing) == 0) & (F.size(said) == 0)).alias("passes"), missing.alias("missing"), said.alias("said"))


def article(c: Column, ordinal: str) -> Column:
    """The text of an article, from its heading to the next ordinal's; null if it has no such heading."""
    head = lambda o: F.regexp_instr(c, F.lit(rf"Art[ií]culo\s+{o}\."))
    at = ORDINALS.index(ordinal)
    begin, end = head(ordinal), head(ORDINALS[at + 1]) if at + 1 < len(ORDINALS) else F.lit(0)
    return F.when(begin > 0, F.substring(c, begin, F.when(end > begin, end - begin).otherwise(F.length(c))))


def before_annex(c: Column) -> Column:
    at = F.regexp_instr(c, F.lit(r"(?m)^\s*ANEXO\s+I\b"))
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def secret_or_dump(c: Column) -> Column:
    """Key blocks, and long runs of base64 that decode to a key's head or to binary data."""
    plain = F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")
    run = (F.length(plain) >= 200) & ~F.contains(F.substring(plain, 1, 200), F.lit(" ")) & plain.rlike(r"^[A-Za-z0-9+/=\s]{200,}$")
    head = F.hex(F.try_to_binary(F.substring(F.regexp_replace(plain, r"\s", ""), 1, 52), F.lit("base64")))
    return c.rlike(PEM) | F.coalesce(run & F.coalesce(head.rlike("^(..)*([89A-F].|424547494E)"), F.lit(True)), F.lit(False))


def is_furniture(line: Column) -> Column:
    """Whether a line is nothing but a page number or a footer with one."""
    return line.rlike(r"\S") & (line.rlike(PAGE_NUMBER) | line.rlike(FOOTER))


def bullets_repaired(c: Column) -> Column:
    """A digit that opens three lines or more without a sign after it was a bullet: it becomes a hyphen. The text is looked at once
    for all digits."""
    opens = lambda d: F.concat(F.lit(r"(?m)^[ \t]*(["), d, F.lit(r"])[ \t]+(?=[A-Za-zÁÉÍÓÚÑáéíóúñ(¿¡])"))

    def repaired(text: Column, opening: Column) -> Column:
        digits = F.filter(F.array(*(F.lit(str(d)) for d in range(10))), lambda d: F.size(F.filter(opening, lambda x: x == d)) >= 3)
        many = lambda found: F.when(F.size(found) > 0, F.regexp_replace(text, opens(F.array_join(found, "")), F.lit("- "))).otherwise(text)
        return F.when(F.size(opening) >= 3, X.let(digits, many)).otherwise(text)

    return X.let(c, lambda text: X.let(F.regexp_extract_all(text, opens(F.lit("0-9")), 1), lambda opening: repaired(text, opening)))


def without_furniture(c: Column) -> Column:
    """Page text without page numbers, alone or glued to a sentence, and with its bullets back; doing it twice changes nothing."""
    lines = F.filter(F.split(bullets_repaired(X.clean_controls(c)), "\n"), lambda x: ~is_furniture(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), GLUED_PAGE, " "), r"[ \t]{2,}", " ")


def _says_something(folder: Column) -> Column:
    words = F.filter(F.split(X.strip_accents(F.lower(folder)), r"[ _\-.]+"), lambda w: F.length(w) > 2)
    return (F.size(words) >= 2) & F.exists(words, lambda w: ~w.isin(STORAGE_FOLDERS))


def unit_of(folders: Column) -> Column:
    """The first folder named like a unit, else the first that says what it is about; null if none does."""
    named = lambda f: F.filter(folders, f)
    return F.coalesce(F.try_element_at(named(lambda x: x.rlike(UNIT)), F.lit(1)), F.try_element_at(named(_says_something), F.lit(1)))


def path_parts(path: Column, single: dict[str, str] | None = None, by_code: dict[str, dict[str, str]] | None = None) -> Column:
    """degree, year, subject, subject_origin and unit of a file, read off its path.

    degree/cursoN/subject/source/... has them all. Elsewhere the first three parts name a source: one in `single` is of one
    subject, in `by_code` its next part is a code of the source's own, known or not, if there is one.
    """
    parts = F.filter(F.split(F.regexp_replace(path, r"^corpus/(derivado/)?", ""), "/"), lambda x: F.length(x) > 0)
    part = lambda i: F.try_element_at(parts, F.lit(i))
    n, tail = F.size(parts), lambda first: F.slice(parts, first, F.greatest(F.size(parts) - first, F.lit(0)))
    source = F.array_join(F.slice(parts, 1, 3), "/")
    pairs = [F.lit(x) for s, names in (by_code or {}).items() for c, v in names.items() for x in (f"{s}/{c}", v)]
    known = F.try_element_at(F.create_map(*pairs), F.concat_ws("/", source, part(4))) if pairs else F.lit(None).cast("string")
    one = F.try_element_at(F.create_map(*(F.lit(x) for kv in single.items() for x in kv)), source) if single else F.lit(None).cast("string")
    course = F.regexp_extract(F.coalesce(part(2), F.lit("")), r"^curso(\d)$", 1)
    dealt, coded = source.isin(list(by_code or {})), F.lit(True) & (n > 4)
    pick = lambda year, single_, code, loose, rest: (
        F.when(course != "", year).when(one.isNotNull(), single_).when(dealt & coded, code).when(dealt, loose).otherwise(rest)
    )
    none = F.lit(None).cast("string")
    subject = pick(F.coalesce(part(3), F.lit("")), one, F.coalesce(known, F.replace(X.strip_accents(F.lower(part(4))), F.lit(" "), F.lit("-"))), F.lit(""), F.coalesce(part(2), F.lit("")))
    origin = pick(F.when(n > 2, "folder"), F.lit("single source"), F.when(known.isNotNull(), "code").otherwise("unknown code"), F.lit("undeclared"), F.lit("folder"))
    folders = pick(tail(5), tail(4), tail(5), tail(4), tail(3))
    return F.struct(
        F.coalesce(part(1), F.lit("")).alias("degree"), F.when(course != "", course.try_cast("int")).alias("year"), F.coalesce(subject, none).alias("subject"), origin.alias("subject_origin"), unit_of(folders).alias("unit")
    )


def title_of(path: Column, text: Column) -> Column:
    """The first heading of three to eighty characters that is no command, where the format has headings; else the file's name."""
    headed = F.lower(path).rlike(r"\.(md|markdown)$") & ~F.lower(path).endswith(".pdf.md")
    heads = F.transform(F.regexp_extract_all(text, F.lit(r"(?Udm)^#{1,3}\s+(.+)$"), 1), lambda h: strip(F.regexp_replace(strip(h), "#+$", "")))
    good = F.filter(heads, lambda h: F.length(h).between(3, 80) & ~h.rlike(ORDER) & ~h.rlike(r"(?U)^[^\s/]*/"))
    name = F.regexp_extract(path, r"[^/]*$", 0)
    plain = F.when(name.rlike(ENDINGS), F.regexp_replace(name, ENDINGS, "")).otherwise(F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""))
    return F.coalesce(F.when(headed, F.try_element_at(good, F.lit(1))), plain)


def context_line(parts: Column, title: Column) -> Column:
    """What stands before each chunk of a file: degree, year, subject, unit and title, as far as they are known."""
    said = lambda c: F.when(F.length(c) > 0, c)
    return F.concat_ws(" · ", said(F.upper(parts["degree"])), F.concat(F.lit("curso "), parts["year"].cast("string")), said(parts["subject"]), said(parts["unit"]), said(title))


def undeclared_sum(c: Column) -> Column:
    """expression and result of the first sum that stands in a prose text, units left out; null if there is none."""
    pattern = F.lit(r"([-+(]?\d[\wáéíóúñ\s.,()^*/+\-×%]*?)\s*=\s*([-+]?\d[\d.,]*)")
    left, right = (F.regexp_extract_all(c, pattern, i) for i in (1, 2))
    trim = lambda x: F.regexp_replace(F.regexp_replace(x, "^[ .,]+", ""), "[ .,]+$", "")
    sums = F.zip_with(left, right, lambda a, b: F.struct(
        trim(F.regexp_replace(F.regexp_replace(F.translate(a, "x×", "**"), "[a-zA-ZáéíóúñÁÉÍÓÚÑ%]+", " "), "^[^0-9(]+", "")).alias("expression"), F.regexp_replace(b, "[.,]+$", "").alias("result")
    ))
    return F.try_element_at(F.filter(sums, lambda s: s["expression"].rlike(r"[-+*/^]") & (F.length(s["result"]) > 0)), F.lit(1))
