"""Counts, rankings, percentiles, sweeps and windows over traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.session import cut


def two_units(df: DataFrame, key: list[str], per: list[str] | None = None) -> DataFrame:
    """Rows, distinct cases of the key, and rows per case. The key must be named."""
    if not key or any(not k.strip() for k in key):
        raise ValueError("a count needs the name of what makes a case")
    out = df.groupBy(*(per or [])).agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct(*key)).alias("n_cases"))
    return out.withColumn("factor", F.round(F.coalesce(F.try_divide(F.col("n_rows"), F.col("n_cases")), F.lit(0.0)), 2))


def verdicts_by_instrument(claims: DataFrame, kind: str = "type", verdict: str = "verdict", instrument: str = "instrument") -> DataFrame:
    """signed_by, verdict and n: verdicts by the instrument that gave them, those that none signed by why that is so."""
    from lantern.operators.checks import unsigned_reason

    by = F.coalesce(F.col(instrument), F.concat(F.lit("unsigned: "), unsigned_reason(F.col(kind), F.col(verdict), F.col(instrument))))
    return claims.groupBy(by.alias("signed_by"), verdict).agg(F.count("*").alias("n"))


def percentage(part: Column, whole: Column) -> Column:
    """Like `75.0 %`, or n/a of nothing."""
    return F.when(whole > 0, F.concat(F.format_number(100 * part / whole, 1), F.lit(" %"))).otherwise("n/a")


def first_of(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The first row of each key by an explicit ordinal."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(ordinal))).where("__n = 1").drop("__n")


def gain(position: Column, k: int = 5) -> Column:
    """nDCG of one relevant item at a 1-based position; 0 if it is absent or below k."""
    return F.when(position <= k, 1 / F.log2(1 + position)).otherwise(F.lit(0.0))


def gold_positions(ranked: DataFrame, gold: DataFrame, query: str, item: list[str]) -> DataFrame:
    """1-based position of each query's gold item, null if it isn't listed; all parts of the item's key must match."""
    return gold.join(ranked.select(query, *item, "rank"), [query, *item], "left").groupBy(*gold.columns).agg(F.min("rank").alias("position"))


def recall_table(positions: DataFrame, group: str, ks: tuple[int, ...] = (6, 20)) -> DataFrame:
    """Recall at each k in percent and mean nDCG at 5, per group and - group null - overall."""
    shares = [F.round(100 * F.avg(F.when(F.col("position") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}") for k in ks]
    return positions.rollup(group).agg(F.count("*").alias("n"), *shares, F.round(F.avg(gain(F.col("position"))), 6).alias("ndcg_5"))


def contaminated(context: DataFrame, query: str, own: str, other: str) -> DataFrame:
    """Queries whose context holds a row of another subject."""
    per = context.groupBy(query).agg(F.max((F.col(own) != F.col(other)).cast("int")).alias("bad"))
    return per.agg(F.count("*").alias("n_queries"), F.sum("bad").alias("n_contaminated"))


def at_ranks(df: DataFrame, value: str, per: list[str], ranks: dict[str, Column]) -> DataFrame:
    """The values at given 0-based ranks of each group, in ascending order; each rank is an expression of the group's count n.

    Nothing sorts a whole group: its distinct values are counted, dealt out in ranges, and only the ranges in which a rank
    falls are numbered. Where ranges begin changes nothing but their sizes. Nulls don't count; a group of nulls has no row.
    """
    key = F.struct(*per) if per else F.lit(0)
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(key.alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c")))
    dealt = cut(counts.repartitionByRange("g", "v").withColumn("r", F.spark_partition_id()))
    sums = dealt.groupBy("g", "r").agg(F.sum("c").alias("c"))  # a row a range
    w = Window.partitionBy("g").orderBy("r")
    sums = sums.select("g", "r", (F.sum("c").over(w) - F.col("c")).alias("before"), F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy("g")).alias("n"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()))).alias("a")
    asked = sums.select("g", "r", "before", "upto", asked).where((F.col("a.rank") >= F.col("before")) & (F.col("a.rank") < F.col("upto"))).select("g", "r", "before", "a.*")
    inner = dealt.join(asked.select("g", "r", "before").distinct(), ["g", "r"])
    inner = inner.withColumn("to", F.col("before") + F.sum("c").over(Window.partitionBy("g", "r").orderBy("v")))
    found = inner.drop("before").join(asked, ["g", "r"]).where(F.col("to") > F.col("rank")).groupBy("g").agg(*(F.min(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ranks))
    return found.select(*(F.col(f"g.{c}").alias(c) for c in per), *ranks)


def _percentiles(df: DataFrame, value: str, per: list[str], points: dict[str, float]) -> DataFrame:
    """Percentiles between the two nearest ranks, by their distance."""
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = {f"{n}{s}": f(place(p)) for n, p in points.items() for s, f in (("_lo", F.floor), ("_hi", F.ceil))}
    return at_ranks(df, value, per, ranks)


def summary(df: DataFrame, value: str, per: list[str], points: dict[str, float] | None = None) -> DataFrame:
    """n, interpolated p50 and p95 (or other points), extremes and mean; nulls don't count, groups of nulls have n 0."""
    v, points = F.col(value), points or {"p50": 0.5, "p95": 0.95}
    plain = df.groupBy(F.struct(*per).alias("g")).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"))
    ranked = _percentiles(df, value, per, points).withColumn("g", F.struct(*per)).drop(*per)
    lo, hi = (lambda n: F.col(f"{n}_lo").cast("double")), (lambda n: F.col(f"{n}_hi").cast("double"))
    between = lambda n, p: F.round(lo(n) + (hi(n) - lo(n)) * (F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))), 6).alias(n)
    return plain.join(ranked, "g", "left").select("g.*", "n", *(between(n, p) for n, p in points.items()), "low", "high", "mean")


def index_quantiles(df: DataFrame, value: str, per: str, divisors: tuple[int, ...] = (4, 10)) -> DataFrame:
    """Quantiles picked by index, v[n // d] in ascending order, not interpolated."""
    return at_ranks(df, value, [per], {f"v_{d}": F.floor(F.col("n") / d) for d in divisors})


def median(df: DataFrame, value: str, per: list[str]) -> DataFrame:
    return summary(df, value, per, {"median": 0.5}).select(*per, "n", "median")


def level_gains(levels: DataFrame, order: str, found: str) -> DataFrame:
    """What each level of a sweep finds beyond the one before it; the first has null. A row a level, of which there are few."""
    return levels.withColumn("gain", F.col(found) - F.lag(found).over(Window.orderBy(order)))


def findings(df: DataFrame, kind: str, per: list[str] | None = None) -> DataFrame:
    """Occurrences and the kinds that occur at all, counted apart."""
    return df.where(F.col(kind).isNotNull()).groupBy(*(per or [])).agg(F.count("*").alias("occurrences"), F.countDistinct(kind).alias("kinds"))


def extrapolated(binary_bytes: Column, text_bytes: Column, chunks: Column, seconds: Column, dimension: int = 1024) -> dict[str, Column]:
    """What a terabyte of such material would take: chunks, hours and gigabytes of vectors, by the ratios seen here."""
    mb, ratio = 1048576, F.try_divide(binary_bytes, text_bytes)
    per_tb = F.try_divide(chunks, text_bytes / mb) * F.try_divide(F.lit(mb), ratio)
    return {
        "ratio": F.round(ratio, 1), "chunks_per_mb": F.round(F.try_divide(chunks, text_bytes / mb), 1), "chunks_per_tb": F.round(per_tb),
        "hours_per_tb": F.round(F.try_divide(per_tb, F.try_divide(chunks, seconds)) / 3600, 1), "gb_per_tb": F.round(per_tb * dimension * 4 / 1073741824, 1),
    }


def overlaps(responses: DataFrame, stages: str, path: str = "$.generacion.cobertura.frases") -> DataFrame:
    """The sentences that a trace has measured, one a row: overlap, and whether it was too short to be judged."""
    rows = F.explode(F.from_json(F.get_json_object(stages, path), "array<struct<solape:double,corta:boolean>>"))
    return responses.select("*", rows.alias("__s")).select(*responses.columns, F.col("__s.solape").alias("overlap"), F.coalesce("__s.corta", F.lit(False)).alias("short"))


def load_levels(runs: DataFrame, level: str, own: str, total: str, degraded: Column) -> DataFrame:
    """Per level of concurrency: our own stage and the whole, apart - the second says more of the provider - and the share degraded."""
    points = {"p50": 0.5, "p95": 0.95}
    a, b = (summary(runs, c, [level], points).withColumnsRenamed({x: f"{name}_{x}" for x in ("n", "p50", "p95", "low", "high", "mean")}) for name, c in (("own", own), ("total", total)))
    share = runs.groupBy(level).agg(F.round(F.avg(F.coalesce(degraded, F.lit(False)).cast("double")), 6).alias("degraded"))
    return a.join(b, level).join(share, level)


def off_corpus_baseline(ranked: DataFrame, query: str, score: str) -> DataFrame:
    """Best score of each question that the corpus cannot answer: the highest and the mean of these bests."""
    best = ranked.groupBy(query).agg(F.max(score).alias("best"))
    return best.agg(F.count("*").alias("questions"), F.round(F.max("best"), 6).alias("highest"), F.round(F.avg("best"), 6).alias("mean"))


def rate_threshold(lowest: DataFrame, value: str, candidates: list[float], margin: float = 0.30, least: int = 30) -> DataFrame:
    """The highest candidate that stays `margin` below the lowest rate seen in sound runs; null with fewer than `least` of them."""
    one = lowest.agg(F.count(value).alias("n"), F.min(value).alias("low"))
    fit = F.array_max(F.filter(F.array(*(F.lit(float(c)) for c in candidates)), lambda c: c <= F.col("low") * (1 - margin)))
    return one.select("n", "low", F.when(F.col("n") >= least, fit).alias("threshold"))


def bar(alone: Column, ceiling: Column) -> Column:
    """What a combination must reach to be worth it: half of what the best alone leaves up to the ceiling."""
    return alone + (ceiling - alone) / 2


def history(df: DataFrame, per: list[str], order: list[str], what: Column, name: str = "history") -> DataFrame:
    """What earlier rows of the same response had, in order."""
    w = Window.partitionBy(*per).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.collect_list(what).over(w))


def trailing_rate(df: DataFrame, per: str, ts: str, seconds: int) -> DataFrame:
    """Events of the last `seconds`, both ends included, as a rate by the fixed window; and its lowest value so far.

    Before a whole window has passed since the first event the rate is null, and so it lowers nothing.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(per).orderBy(at)
    begun = F.min(at).over(w.rangeBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("n_window", F.count("*").over(w.rangeBetween(-seconds * 1_000_000, 0)))
    rows = rows.withColumn("rate", F.when(at - begun >= seconds * 1_000_000, F.col("n_window") / F.lit(float(seconds))))
    return rows.withColumn("lowest", F.min("rate").over(w.rangeBetween(Window.unboundedPreceding, 0)))


def durations(df: DataFrame, per: str, ts: str, tie: str) -> DataFrame:
    """Milliseconds since the mark before."""
    w = Window.partitionBy(per).orderBy(ts, tie)
    return df.withColumn("ms", ((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w))) / 1000).cast("double"))


def sweep(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """For each threshold how many rows are judged and how many are marked, being below it: one pass, a few numbers."""
    counts = df.agg(F.count(value).alias("judged"), *(F.count_if(F.col(value) < x).alias(f"m{i}") for i, x in enumerate(thresholds)))
    pick = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("threshold"), F.col(f"m{i}").alias("marked")) for i, x in enumerate(thresholds))))
    return counts.select("judged", pick.alias("p")).select("p.threshold", "judged", "p.marked", F.round(F.try_divide(F.col("p.marked"), F.col("judged")), 6).alias("rate"))


def highest_admissible(swept: DataFrame, ceiling: float = 0.25) -> DataFrame:
    """The highest threshold whose rate is at most the ceiling; no row if there is none."""
    return swept.where(F.col("rate") <= ceiling).orderBy(F.desc("threshold")).limit(1)


def calibration_plane(df: DataFrame, positive: Column, coverage: str, score: str, floors: list[float], thresholds: list[float]) -> DataFrame:
    """For each floor and threshold: positives verified, lost and below the floor, and negatives approved."""
    cells = [(f, t) for f in floors for t in thresholds]
    parts = []
    for i, (f, t) in enumerate(cells):
        judged, passed = F.col(coverage) >= f, F.col(score) >= t
        parts += [F.count_if(positive & judged & passed).alias(f"a{i}"), F.count_if(positive & judged & ~passed).alias(f"b{i}"), F.count_if(positive & ~judged).alias(f"c{i}"), F.count_if(~positive & judged & passed).alias(f"d{i}")]
    one = df.agg(*parts)
    rows = F.explode(F.array(*(F.struct(F.lit(float(f)).alias("floor"), F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("verified"), F.col(f"b{i}").alias("lost"), F.col(f"c{i}").alias("below"), F.col(f"d{i}").alias("approved")) for i, (f, t) in enumerate(cells))))
    return one.select(rows.alias("r")).select("r.*")


def best_cell(plane: DataFrame) -> DataFrame:
    """Most positives among cells without approved negatives, then the lowest threshold and floor; else the fewest approved."""
    return plane.orderBy((F.col("approved") > 0).cast("int"), F.when(F.col("approved") > 0, F.col("approved")).otherwise(0), F.desc("verified"), "threshold", "floor").limit(1)


def transitions(df: DataFrame, per: str, order: list[str], what: str) -> DataFrame:
    """Before and after matrix of consecutive rows, changes only."""
    before = F.lag(what).over(Window.partitionBy(per).orderBy(*order))
    return df.select(before.alias("before"), F.col(what).alias("after")).where("before is not null and before != after").groupBy("before", "after").agg(F.count("*").alias("n"))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """(in * price + out * price) per million tokens, as exact money; null without prices."""
    return ((tokens_in * price_in + tokens_out * price_out) / F.lit(1_000_000)).cast("decimal(18,6)")
