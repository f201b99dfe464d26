"""Verdicts on claims: literal quotes, arithmetic, coverage, and the policy around an outside entailment model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import text as X
from lantern.functions.corpus import undeclared_sum

# Least entailment, least coverage to ask at all, sentence coverage, shortest judged sentence.
ENTAILMENT, LEAST_COVERAGE, SENTENCE_COVERAGE, LEAST_WORDS = 0.90, 0.25, 0.50, 3


def in_context(chunk_id: Column, context: Column) -> Column:
    return F.coalesce(F.array_contains(context, chunk_id), F.lit(False))


def literal_verdict(quote: Column, chunk: Column, chunk_id: Column, context: Column, level: str = "spaces") -> Column:
    """Provenance first: a quote of a chunk that wasn't in the context is cut even if it is right. A quote that isn't there
    word for word, or a blank one, is judged as a paraphrase instead."""
    return F.when(~in_context(chunk_id, context), "podada").when(X.holds(chunk, quote, level), "verificada").otherwise("degradada_a_parafrasis")


def literal_reason(quote: Column, chunk: Column, chunk_id: Column, context: Column, level: str = "spaces") -> Column:
    """Why a quote isn't verified, or null."""
    blank = F.coalesce(X.collapse(quote) == "", F.lit(True))
    return F.when(~in_context(chunk_id, context), "procedencia_fabricada").when(blank, "sin_cita").when(~X.holds(chunk, quote, level), "no_es_subcadena")


def only_accents(quote: Column, chunk: Column) -> Column:
    """Whether the quote would be there but for accents: a sign that it was rewritten, not copied."""
    return X.holds(X.strip_accents(chunk), X.strip_accents(quote), "typography")


def entailment_verdict(label: Column, probability: Column, coverage: Column, is_code: Column, entailment: float = ENTAILMENT, floor: float = LEAST_COVERAGE) -> Column:
    """Too little in common or code isn't asked; contradiction always cuts; entailment must be sure; else try again."""
    return F.when((coverage < floor) | is_code, "no_verificable").when(label == "contradiction", "podada").when((label == "entailment") & (probability >= entailment), "verificada").otherwise("reintento")


# Marks of code.
CODE_MARKS = r"[{};]|\)\s*\{|=>|->|\bnew\b|\breturn\b|\bpublic\b|\bprivate\b|\bvoid\b"


def is_code(c: Column) -> Column:
    """Three marks of code, or two in a text of several lines."""
    marks = F.regexp_count(c, F.lit(CODE_MARKS))
    return (marks >= 3) | ((marks >= 2) & (F.size(X.lines_of(c)) > 1))


def sentence_backing(sentence: Column, support: Column, least: float = SENTENCE_COVERAGE) -> Column:
    """short, backed or unbacked; words about the source itself don't count, and empty support backs nothing."""
    own = X.content_words(sentence, X.EMPTY_WORDS + X.META_WORDS)
    return F.when(F.size(own) < LEAST_WORDS, "short").when((F.size(support) > 0) & (X.coverage(support, own) >= least), "backed").otherwise("unbacked")


def support_of(claims: Column) -> Column:
    """The words that back the prose of an answer: those of its claims, given as JSON objects, and of their quotes. Scaffolding
    with a sum in it backs nothing, else a sum that nobody checked would allow what is built on it."""
    get = lambda x, n: F.coalesce(F.get_json_object(x, f"$.{n}"), F.lit(""))
    own = lambda x: F.array_union(X.content_words(get(x, "texto")), X.content_words(get(x, "cita")))
    summed = lambda x: (get(x, "tipo") == "andamiaje") & undeclared_sum(get(x, "texto")).isNotNull()
    return F.array_distinct(F.flatten(F.transform(F.filter(claims, lambda x: ~summed(x)), own)))


def final_verdict(*verdicts: Column) -> Column:
    return F.coalesce(*verdicts, F.lit("sin_verificar"))


def abstains(valid: Column, total_ms: Column, prose: Column, deadline: int = 8000) -> Column:
    """Why nothing is answered, or null."""
    return F.when(~valid, "contract").when(total_ms > deadline, "deadline").when(F.length(F.regexp_replace(F.coalesce(prose, F.lit("")), r"(?U)\s", "")) == 0, "empty")


def late(verdict_ms: Column, closed_ms: Column, verdict: Column, budget: int = 2000) -> Column:
    """Verdicts that came after the budget stay unverified."""
    return F.when(verdict_ms - closed_ms > budget, "sin_verificar").otherwise(verdict)


# Kinds of claims, the fields each may have besides those of all, and limits.
CLAIM_KINDS = {"literal": ["cita"], "parafrasis": ["apoyo"], "calculo": ["expresion", "resultado_afirmado"], "codigo": ["codigo"], "conocimiento": [], "andamiaje": ["andamiaje"]}
COMMON_FIELDS, CITED, NUMERIC = ["id", "tipo", "texto", "fragmento_id"], ["literal", "parafrasis"], r"^-?\d+(?:[.,]\d+)?$"
MOST_CLAIMS, LEAST_TEXT, MOST_QUOTE = 10, 13, 120


def claim_errors(claim: Column) -> Column:
    """The rules that a claim, given as a JSON object, breaks, in a fixed order; an empty list if none.

    unreadable, unknown field, id, type, short text, text names a type, chunk (cited kinds need F and digits), quote (1 to
    120 characters of a literal), support, expression, result (a plain number).
    """
    get = lambda n: F.get_json_object(claim, f"$.{n}")
    keys, kind, text = F.json_object_keys(claim), get("tipo"), get("texto")
    blank = lambda c: F.coalesce(F.length(X.collapse(c)) == 0, F.lit(True))
    allowed = F.lit(None).cast("array<string>")
    for name, more in CLAIM_KINDS.items():
        allowed = F.when(kind == name, F.array(*(F.lit(f) for f in COMMON_FIELDS + more))).otherwise(allowed)
    rules = [
        (keys.isNull(), "unreadable"),
        (F.size(F.array_except(keys, allowed)) > 0, "unknown field"),
        (blank(get("id")), "id"),
        (~F.coalesce(kind.isin(list(CLAIM_KINDS)), F.lit(False)), "type"),
        (F.coalesce(F.length(text), F.lit(0)) < LEAST_TEXT, "short text"),
        (F.lower(F.trim(text)).isin(list(CLAIM_KINDS)), "text names a type"),
        (kind.isin(CITED) & ~F.coalesce(get("fragmento_id").rlike(r"^F\d+$"), F.lit(False)), "chunk"),
        ((kind == "literal") & ~F.coalesce(F.length(F.trim(get("cita"))).between(1, MOST_QUOTE), F.lit(False)), "quote"),
        ((kind == "parafrasis") & get("apoyo").isNotNull() & blank(get("apoyo")), "support"),
        ((kind == "calculo") & blank(get("expresion")), "expression"),
        ((kind == "calculo") & ~F.coalesce(F.trim(get("resultado_afirmado")).rlike(NUMERIC), F.lit(False)), "result"),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for c, n in rules)))
    return F.when(keys.isNull(), F.array(F.lit("unreadable"))).otherwise(found)


def answer_errors(answer: Column, claims: str = "$.afirmaciones") -> Column:
    """Errors of a whole answer, given as JSON: too many claims, repeated ids, and each claim's own as `place: error`."""
    items = F.from_json(F.get_json_object(answer, claims), "array<string>")
    ids = F.transform(items, lambda x: F.get_json_object(x, "$.id"))
    own = F.flatten(F.transform(items, lambda x, i: F.transform(claim_errors(x), lambda e: F.concat((i + 1).cast("string"), F.lit(": "), e))))
    some = F.array_compact(F.array(F.when(items.isNull(), "no claims"), F.when(F.size(items) > MOST_CLAIMS, "too many claims"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated ids")))
    return F.concat(some, F.coalesce(own, F.array().cast("array<string>")))


def pair_probe(chunk: str, claim: str, quote: str) -> Column:
    """What an entailment check would be asked about a pair, by the service's own steps: premise, route, coverage, whether it
    is code, and whether the premise holds the quote. Code and pairs without a premise are not asked."""
    from lantern.operators.evidence import premise_of

    found = premise_of(chunk, quote, claim)
    premise = found["premise"]
    own = X.content_words(F.col(claim))
    held = X.holds(X.strip_accents(premise), X.strip_accents(F.col(quote)), "lower")
    return F.struct(
        premise.alias("premise"), found["route"].alias("route"), F.round(X.coverage(X.content_words(F.coalesce(premise, F.lit(""))), own), 4).alias("coverage"),
        F.coalesce(is_code(premise), F.lit(False)).alias("is_code"), F.coalesce(held, F.lit(False)).alias("anchored"), (premise.isNotNull() & ~is_code(premise)).alias("asked"),
    )
