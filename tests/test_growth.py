"""What keeps queries from growing faster than their tables."""

import difflib
import random
from decimal import localcontext

import pyarrow as pa
from pyspark.sql import functions as F

from lantern.functions import calc, teaching
from lantern.functions import corpus as C
from lantern.functions import text as X
from lantern.operators import evidence, lexical
from lantern.plans import QUERIES


def test_each_word_is_stemmed_once(spark):
    words = spark.createDataFrame([("Gatos",), ("gato",), ("gatos",), ("perro",)], "w string")
    found = lexical.collisions(words, "w")
    assert [(r.stem, r.words) for r in found.collect()] == [("gat", ["gato", "gatos"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan[plan.index("stems(") :].split("\n", 1)[1]  # distinct stands below the stemming


def passes(spark, column, part):
    """How often an expression stands in the plan of a column."""
    df = spark.createDataFrame([("x",)], "t string").select(column(F.col("t")).alias("v"))
    return df._jdf.queryExecution().optimizedPlan().toString().count(part)


def test_pages_are_cleaned_of_controls_once(spark):
    assert passes(spark, C.without_furniture, "regexp_replace(t#") == 1
    page = "9 uno\n 9\tdos\n9 Tres\n8 cuatro\n8 cinco\n0 seis\n0 siete\n0 ocho\r9\n"
    assert spark.createDataFrame([(page,), (None,), ("",)], "t string").select(C.bullets_repaired(F.col("t"))).collect() == [("- uno\n- dos\n- Tres\n8 cuatro\n8 cinco\n- seis\n- siete\n- ocho\r9\n",), (None,), ("",)]


def test_chunk_gate_looks_at_lines_only_where_a_sign_of_machines_stands(spark):
    plan = lambda c: str(spark.createDataFrame([("x",)], "t string").select(c(F.col("t")).alias("v"))._jdf.queryExecution().optimizedPlan())
    for sign in (s for of in X.MACHINE_SIGNS.values() for s in of):
        assert f", {sign})" in plan(X.chunk_verdict)
    lines = ["Setting up x", "Unpacking x", "Get:1 x", "Reading package lists", "Preparing to unpack x", "3 upgraded, 2 newly", "Need to get 3", "After this operation"]
    mail = ["DKIM-Signature: a", "Received: from a", "Content-Transfer-Encoding: a", "X-Spam: a", "MIME-Version: 1", "  bh=" + "aB3/" * 10, "=" + "a" * 40]
    console = ["icmp_seq=1", "link/ether a", "64 bytes from a", "PING a (b", "inet 1", "inet6 1", "rtt min/avg/max"]
    other = ["DIRECTORY ACCESS IS FORBIDDEN", "INDEX OF /", "403 forbidden", "[a](b)\n" * 6, "see www." + "a1" * 99 + " x", "a1" * 99, "inet x, setting up, PING a.", ""]
    got = spark.createDataFrame([(x,) for x in lines + mail + console + other], "t string").select(X.chunk_verdict(F.col("t"))).collect()
    want = ["package manager output"] * len(lines) + ["mail headers"] * len(mail) + ["console output"] * len(console)
    assert [r[0] for r in got] == want + ["directory page"] * 3 + ["list of links", None, "dump of long tokens", None, "dump of long tokens"]


def test_code_is_cut_in_small_lots(spark, monkeypatch):
    monkeypatch.setattr(teaching, "AT_ONCE", 1000)
    made, method = [], "    void m(int a) {\n        x(a);\n    }\n"
    texts = ["class C {\n" + method * n + "}\n" for n in (0, 1, 40, 3, 90)] + [None, " \n"]

    class Rows:
        """A table that keeps the function which would run on it."""

        schema = spark.range(1).select(F.col("id"), F.lit("x").alias("text")).schema
        select = lambda self, *_: self
        withColumnRenamed = lambda self, *_: self

        def mapInArrow(self, run, _):
            made.append(run)
            return self

    teaching.code_chunks(Rows(), "id", "text", 60)
    out = list(made[0](iter([pa.RecordBatch.from_pydict({"id": list(range(7)), "text": texts})])))
    assert len(out) > 2
    rows = [r for b in out for r in b.to_pylist()]
    whole = lambda i: "".join(r["text"] for r in rows if r["id"] == i)
    assert [whole(i) for i in range(5)] == texts[:5] and whole(5) == whole(6) == ""
    assert all([r["ord"] for r in rows if r["id"] == i] == list(range(sum(r["id"] == i for r in rows))) for i in range(7))
    assert max(r["tokens"] for r in rows) <= 60


def test_pi_is_worked_out_once_for_each_precision():
    before = calc._pi.cache_info().misses
    for n in range(101, 121):
        assert calc.verdict(f"sin({n})^2 + cos({n})^2", "1")[0] == "verificada"
    assert calc._pi.cache_info().misses <= before + 1
    with localcontext() as c:
        c.prec = 60
        assert str(calc.pi())[:40] == "3.14159265358979323846264338327950288419" and len(str(calc.pi())) == 61
        c.prec = 20
        assert len(str(calc.pi())) == 21
    assert [calc.verdict("2+2", s)[0] for s in ("4", "5", "4")] == ["verificada", "podada", "verificada"]
    assert calc.verdict("1/3", "0," + "3" * 300)[0] == "verificada"


def test_claims_of_one_small_file_are_dealt(spark):
    assert QUERIES["calc_verifier"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_run_ends_take_no_sum_anew_for_each_row(spark):
    rows = spark.range(50).select(F.col("id").alias("i"), F.floor(F.col("id") / 7).alias("g"))
    found = evidence.run_ends(rows, "i", "g", 8)
    assert {r.i: r.next for r in found.collect()} == {i: (i // 7 + 1) * 7 if i < 49 else 50 for i in range(50)}
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_matching_blocks_are_the_librarys():
    r = random.Random(13)
    for _ in range(300):
        a, b = ("".join(r.choices("abc d", k=r.randint(0, 60))) for _ in range(2))
        assert evidence.Matcher(None, a, b, autojunk=False).get_matching_blocks() == difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    found = evidence.Matcher(None, "ab", "xxab" * 500, autojunk=False)
    found.b2j = {}  # single signs are not looked at where a longer run agrees
    assert tuple(found.find_longest_match(0, 2, 1998, 2000)) == (0, 1998, 2)
