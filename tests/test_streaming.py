"""Streams: the exact trailing rate whatever the micro-batches, early claims, and a trace that survives replays."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from lantern.streaming import tokens, trace, watch

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def run(stream, name, place):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{place}/c-{name}").start()
    assert q.awaitTermination(180)
    return q


def paces(r):
    """Seconds of tokens, in 64ths so that floats are exact: sound ones, slow ones, gaps, short ones."""
    out = {}
    for i, rates in enumerate([[100] * 4, [100, 100, 11, 11], [4] * 6, [38] * 6, [100, 30, 30, 100], [20] * 3, [64, 34, 64], [2]]):
        t, at = r.randint(0, 64), []
        for pace in rates:
            for _ in range(pace):
                t += max(1, round(64 / pace)) if r.random() < 0.9 else 1
                at.append(t)
            t += 60 if r.random() < 0.3 else 0
        out[i] = [x / 64 for x in at]
    return out


@pytest.mark.parametrize("batches,late", [(1, 0), (5, 0), (4, 3)])
def test_rate_is_cut_at_the_same_token_whatever_the_micro_batches(spark, tmp_path, batches, late):
    r = random.Random(batches + late)
    times = paces(r)
    rows = sorted((s, i, n) for i, at in times.items() for n, s in enumerate(at))
    if late:  # out of order by no more than the watermark allows
        rows.sort(key=lambda x: x[0] + r.random() * late)
    rows = [(i, n, START + datetime.timedelta(seconds=s)) for s, i, n in rows]
    size = -(-len(rows) // batches)
    files = [rows[k : k + size] for k in range(0, len(rows), size)] + [[(99, k, START + datetime.timedelta(seconds=1000 * (k + 1)))] for k in range(2)]
    for k, part in enumerate(files):
        spark.createDataFrame(part, "response_id long, seq long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    source = spark.readStream.schema("response_id long, seq long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    name = f"rates{batches}{late}"
    run(watch.rate_watch(source, late=f"{late + 1} seconds", idle_ms=60_000), name, tmp_path)
    got = spark.sql(f"SELECT * FROM {name} WHERE response_id < 99").collect()
    cuts = {g["response_id"]: g for g in got if g["event"] == "cut"}
    want = {i: tokens.cut_at(at) for i, at in times.items()}
    assert {i: c["seq"] for i, c in cuts.items()} == {i: n for i, n in want.items() if n is not None}
    assert 2 <= len(cuts) < len(times)
    for i, c in cuts.items():
        assert c["rate"] == tokens.rates(times[i])[c["seq"]] < 35 and c["tokens"] == c["seq"] + 1
    ends = {g["response_id"]: g for g in got if g["event"] == "end"}
    assert set(ends) == set(times)
    for i, e in ends.items():
        judged = [x for n, x in enumerate(tokens.rates(times[i])) if x is not None and n >= 8 and (want[i] is None or n <= want[i])]
        assert e["lowest"] == (min(judged) if judged else None)
        if want[i] is None:
            assert e["tokens"] == len(times[i]) and e["rate"] == tokens.rates(times[i])[-1]


def test_watch_of_the_measured_cases():
    def fed(pace, n):
        w = watch.Watch(35.0, 8, 2_000_000)
        cut = [w.feed(i, round((i + 1) * 1_000_000 / pace)) for i in range(n)]
        return next((i for i, c in enumerate(cut) if c is not None), None), w

    assert fed(105, 400)[0] is None and fed(38, 300)[0] is None and fed(2, 8)[0] is None
    for pace in (4, 11, 20):
        at, w = fed(pace, 400)
        assert (at + 1) / pace < 3.0 and w.lowest == pytest.approx(pace, rel=0.15) and w.total == at + 1
    w = watch.Watch(35.0, 8, 2_000_000)
    assert w.rate(5) is None  # null isn't 0


CLAIMS = [{"tipo": "cita", "texto": 'un "texto" [con] {todo}', "fragmento": "F12"}, {"tipo": "conocimiento", "texto": "ü", "fragmento": None, "veredicto": "verificada"}, {"tipo": "calculo", "texto": "2+2", "expresion": "2+2"}]
ANSWER = json.dumps({"otro": {"afirmaciones": [1]}, "afirmaciones": CLAIMS, "prosa": 'va ["a"] después', "n": [1, 2]}, ensure_ascii=False)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_claims_come_before_the_end(size):
    p, out = tokens.EarlyArray(), []
    for i in range(0, len(ANSWER), size):
        out.append(p.feed(ANSWER[i : i + size]))
        p = tokens.EarlyArray(state=p.state())
    assert [json.loads(x) for x in out if x] == [CLAIMS]
    if size < 1000:
        assert next(i for i, x in enumerate(out) if x) * size < ANSWER.index("prosa") + size
    assert tokens.EarlyArray().feed(ANSWER[: ANSWER.index("prosa") - 10]) is None or size
    assert tokens.EarlyArray().feed('{"afirmaciones": [{"a": "]"') is None


def test_claims_out_of_a_stream(spark, tmp_path):
    rows = [(i, n, ANSWER[n * 7 : n * 7 + 7]) for i in range(3) for n in range(-(-len(ANSWER) // 7))]
    rows += [(5, n, t) for n, t in enumerate(['{"afirmaciones": [{"tipo"', None])]
    for k in range(3):
        spark.createDataFrame([x for x in rows if x[1] % 30 // 10 == k and x[1] < 30 or k == 2 and x[1] >= 30], "response_id long, seq long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("response_id long, seq long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(tokens.claims_stream(source), "claims", tmp_path)
    got = trace.claims_of(spark.table("claims")).orderBy("response_id", "n").collect()
    assert [(g.response_id, g.n, g.type, g.text, g.chunk_id, g.verdict) for g in got[:3]] == [(0, 1, "cita", CLAIMS[0]["texto"], 12, "sin_verificar"), (0, 2, "conocimiento", "ü", None, "verificada"), (0, 3, "calculo", "2+2", None, "sin_verificar")]
    assert len(got) == 9 and [json.loads(g.detail) for g in got[:3]] == CLAIMS


def test_unreadable_claims(spark):
    df = spark.createDataFrame([(1, "[{"), (2, None), (3, "[]"), (4, '[{"tipo": "x", "fragmento": "Fx"}]')], "response_id int, claims string")
    assert [(r.response_id, r.n, r.chunk_id) for r in trace.claims_of(df).collect()] == [(4, 1, None)]


ROWS = "request_id long, response_id long, text string, mode string, model string, total_ms int, claims string, stages map<string,int>"


def answer(i, n=2):
    claims = [{"tipo": "cita", "texto": f"t{i}-{k}", "fragmento": f"F{k}"} for k in range(n)]
    return (i, 100 + i, f"pregunta {i}", "responder", "m", 10 * i, json.dumps(claims), {"ttft": i})


def test_a_killed_batch_is_replayed_and_adds_nothing(spark, tmp_path):
    path = f"{tmp_path}/trace"
    for k in range(3):
        rows = [answer(i) for i in range(k * 4, k * 4 + 4)] + ([answer(1)] if k == 2 else [])  # an answer that comes again
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    sink, killed = trace.trace_sink(path), []

    def dying(batch, batch_id):
        if batch_id == 1 and not killed:
            killed.append(batch_id)
            tables = trace.tables_of(batch)  # dies with two of three tables written
            for name in trace.TABLES[:2]:
                tables[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
            raise RuntimeError("killed")
        sink(batch, batch_id)

    def start():
        source = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return source.writeStream.foreachBatch(dying).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()

    with pytest.raises(Exception, match="killed"):
        start().awaitTermination(120)
    torn = trace.read_trace(spark, path)
    assert {t: df.count() for t, df in torn.items()} == {"requests": 4, "claims": 8, "responses": 4}
    assert start().awaitTermination(120)
    sink(spark.read.schema(ROWS).parquet(f"{tmp_path}/in/1"), 1)  # and once more
    whole = trace.read_trace(spark, path)
    assert {t: df.count() for t, df in whole.items()} == {"requests": 12, "claims": 24, "responses": 12}
    one = whole["responses"].where("response_id = 103").first()
    assert (one.request_id, one.total_ms, json.loads(one.payload), one.cost) == (3, 30, {"stages": {"ttft": 3}}, None)
    assert sorted(r[0] for r in whole["claims"].where("response_id = 101").select("text").collect()) == ["t1-0", "t1-1"]
    assert whole["requests"].agg(F.countDistinct("request_id")).first()[0] == 12
