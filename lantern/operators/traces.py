"""What a stored response tells: stage marks, spans and their rates, why a stage gave up, and its trace as four answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.checks import unsigned_reason

# Seconds to wait for a turn and for the work itself, and the share of the turn's wait that means a queue.
QUEUE_WAIT, WORK_WAIT, QUEUE_SHARE = 2.0, 2.0, 0.25


def stage_marks(events: DataFrame, response: str, ts: str, name: str, tie: str) -> DataFrame:
    """Each mark's milliseconds since its response's first event, to one decimal, and its place."""
    w = Window.partitionBy(response)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    number = F.row_number().over(w.orderBy(ts, tie))
    return events.select(response, F.col(name).alias("name"), number.alias("n"), F.round((at - F.min(at).over(w)) / 1000, 1).alias("ms"))


def rate(tokens: Column, ms: Column) -> Column:
    """Tokens a second to one decimal; null of no tokens or no time."""
    return F.when((tokens > 0) & (ms > 0), F.round(tokens / (ms / 1000), 1))


def spans(responses: DataFrame, provider: str = "ttft_provider_ms", prose: str = "ttft_prose_ms", total: str = "total_ms", before: str = "tokens_before_prose", tokens: str = "tokens_total") -> DataFrame:
    """The three spans of a wait - until the first token, claims, prose - with their milliseconds, tokens and rates.

    A time of 0 counts as missing, as do tokens: a span without one of its ends is null.
    """
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    claims, rest, words = some(prose) - some(provider), F.col(total) - some(prose), some(tokens) - some(before)
    return responses.withColumns({
        "prefill_ms": F.round(some(provider), 1), "claims_ms": F.round(claims, 1), "claims_tokens": F.col(before), "claims_rate": rate(F.col(before), claims),
        "prose_ms": F.round(rest, 1), "prose_tokens": words, "prose_rate": rate(words, rest),
    })


def gave_up(asked: Column, started: Column, ended: Column, queue: float = QUEUE_WAIT, work: float = WORK_WAIT, share: float = QUEUE_SHARE) -> Column:
    """Why a stage that waits for a turn was left out, from its times in seconds; null if it ended in time.

    saturated: it never began, or a good part of the turn's wait went by first - that is load, not a fault. unresponsive: it began
    soon and still didn't end.
    """
    limit = F.when(started.isNotNull() & (started - asked <= queue), F.lit(max(queue, work))).otherwise(F.lit(min(queue, work)))
    late = ended.isNull() | (ended - asked > limit)
    waited = started.isNull() | (started - asked > limit) | (started - asked > queue * share)
    return F.when(late, F.when(waited, "saturated").otherwise("unresponsive"))


# Fields of a claim's detail that its public forms show.
CLAIM_FIELDS = ["id_en_contrato", "cita", "apoyo", "expresion", "andamiaje", "fragmento_en_contexto"]
VERDICT_FIELDS = ["instrumento", "motivo", "detalle", "nli", "probabilidad", "cobertura", "seleccion", "umbral", "suelo", "nivel", "solo_tildes", "recalculado", "comparacion", "calculo_no_declarado", "operandos_sin_fuente"]


def _fields(detail: str, path: str, names: list[str]) -> list[Column]:
    return [F.get_json_object(detail, f"{path}.{n}").alias(n) for n in names]


def public_claim(detail: str = "detail") -> Column:
    """What a claim says and leans on, out of its nested detail."""
    return F.struct(F.col("claim_id").alias("id"), F.col("type").alias("tipo"), F.col("text").alias("texto"), F.col("chunk_id").alias("fragmento_id"), *_fields(detail, "$", CLAIM_FIELDS))


def public_verdict(detail: str = "detail") -> Column:
    """What a claim was found to be, by which instrument - or why by none - and what that instrument measured."""
    signed = F.get_json_object(detail, "$.verificacion.instrumento")
    why = unsigned_reason(F.col("type"), F.col("verdict"), signed).alias("sin_firma_porque")
    return F.struct(F.col("claim_id").alias("id"), F.col("type").alias("tipo"), F.col("verdict").alias("veredicto"), why, *_fields(detail, "$.verificacion", VERDICT_FIELDS))


def trace(requests: DataFrame, responses: DataFrame, claims: DataFrame) -> DataFrame:
    """One row a response: question, retrieved, claimed, judged and cost. Stages are JSON; claims come in order of id.

    A response that retrieved or claimed nothing says so with empty lists; one that doesn't exist has no row.
    """
    stage = lambda path: F.get_json_object("stages", path)
    per = claims.groupBy("response_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("claim_id", public_claim().alias("c"), public_verdict().alias("v")))), lambda x: F.struct(x["c"], x["v"])).alias("said"),
        F.count("*").alias("n_claims"),
    )
    rows = responses.join(requests.withColumnsRenamed({"ts": "asked_at"}), "request_id", "left").join(per, "response_id", "left")
    context = F.coalesce(F.from_json(stage("$.recuperacion.en_contexto"), "array<bigint>"), F.array().cast("array<bigint>"))
    rows = rows.withColumn("context", context)
    split = lambda f: F.coalesce(F.transform("said", lambda x: x[f]), F.array())
    return rows.select(
        "response_id",
        F.struct("request_id", "text", "mode", "subject_id", "asked_at", "version_prompt").alias("question"),
        F.struct("context", F.size("context").alias("n_context"), stage("$.recuperacion.confianza").alias("confidence"), F.coalesce(stage("$.recuperacion.construido") == "true", F.lit(False)).alias("retrieved")).alias("retrieved"),
        F.struct(split("c").alias("claims"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), "abstained", stage("$.generacion.motivo_fallo").alias("failure")).alias("claimed"),
        F.struct(split("v").alias("verdicts"), F.coalesce(stage("$.verificacion.construido") == "true", F.lit(False)).alias("verified")).alias("judged"),
        F.struct("ttft_ms", "total_ms", "tokens_in", "tokens_out", "cost", stage("$.marcas").alias("marks")).alias("spent"),
    )
