"""Near duplicates, misfiled documents and contradictions among vectors and texts of a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Near duplicate, lower end of the candidate band, share of a misfiled document, sentence overlap, contradiction.
NEAR, BAND, MISFILED, OVERLAP, CONTRADICTION = 0.95, 0.80, 0.10, 0.20, 0.90
#: Rows of a block, of which a group has few - each row is copied once for each -, and blocks that a group may have for the sake
#: of more tasks, if they keep as many rows as SMALL; rows whose products are held at once; half a unit of the last place kept.
BLOCK, BLOCKS, SMALL, TILE, HALF = 16_000, 8, 2000, 256, 0.5e-6


def _cells(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Rows in cells - pairs of blocks of a group: each pair of rows of a group meets in exactly one cell."""
    n = F.count("*")
    sizes = rows.groupBy(group).agg(F.greatest(F.ceil(n / block), F.least(F.ceil(n / min(SMALL, block)), F.lit(BLOCKS))).cast("int").alias("blocks"))
    dealt = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.withColumn("other", other).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other", "blocks")


def _sides(pdf: pd.DataFrame, x: int, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A cell's rows as unit vectors, and the places of those that are compared with each other: of its two blocks, or all."""
    v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    block = pdf["block"].to_numpy()
    return v, np.flatnonzero(block == x), np.flatnonzero(block == y)


def _kept(vectors: DataFrame, column: str) -> Column:
    """Vectors as they are stored, if that is in numbers that Python has."""
    kind = vectors.schema[column].dataType.simpleString()
    return F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")


def similar_pairs(vectors: DataFrame, least: float, id_column: str, vector_column: str, group: str, ordinal: str | None = None, document: str | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of a group with a cosine that rounds to at least `least`; neighbours within a document (ordinals at most one apart) don't count.

    A group's rows are compared in cells of two blocks, each a matrix product; only pairs that reach the bound leave the task.
    """
    extra = [F.col(c).cast("long").alias(n) if c else F.lit(None).cast("long").alias(n) for c, n in ((ordinal, "ordinal"), (document, "document"))]
    rows = vectors.where(F.col(vector_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(group).cast("long").alias("g"), _kept(vectors, vector_column).alias("v"), *extra)

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        v, one, two = _sides(pdf, x, y)
        ids, other = pdf["id"].to_numpy(), v[two].T
        out = []
        for lo in range(0, len(one), TILE):
            mine = one[lo : lo + TILE]
            s = v[mine] @ other
            i, j = np.nonzero(s >= least - HALF - 1e-9)  # what rounds up to the bound is told after rounding
            found, i, j = s[i, j], mine[i], two[j]
            ok = ids[i] < ids[j] if x == y else ids[i] != ids[j]
            found, i, j = found[ok], i[ok], j[ok]
            out.append(pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "similarity": found, "i": i, "j": j}))
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in ("a", "b", "similarity", "i", "j")}).astype({"i": int, "j": int})
        if ordinal and document:
            o, d = pdf["ordinal"].to_numpy(), pdf["document"].to_numpy()
            near = (d[found["i"]] == d[found["j"]]) & (np.abs(o[found["i"]] - o[found["j"]]) <= 1)
            found = found[~near]
        return found.assign(g=key[0])[["g", "a", "b", "similarity"]]

    found = _cells(rows, "g", block).groupBy("g", "x", "y").applyInPandas(pairs, "g long, a long, b long, similarity double")
    return found.select(F.col("g").alias(group), "a", "b", F.round("similarity", 6).alias("similarity")).where(F.col("similarity") >= least)


def duplicate_kind(pairs: DataFrame, near: float = NEAR, band: float = BAND) -> DataFrame:
    return pairs.withColumn("kind", F.when(F.col("similarity") >= near, "near_duplicate").when(F.col("similarity") >= band, "candidate"))


def _first(place: np.ndarray, similarity: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each place's matches the most similar, ties to the smaller id."""
    order = np.lexsort((ids, -similarity, place))
    return order[np.concatenate([[True], place[order][1:] != place[order][:-1]])[: len(order)]]


def nearest_outside(vectors: DataFrame, id_column: str, vector_column: str, group: str, block: int = BLOCK) -> DataFrame:
    """For each row its best match in another group: id, group, best_id, best_group, similarity. Rows without a group
    have none.

    All rows are dealt to blocks; a cell of two blocks returns each row's best there, and the best of those counts.
    """
    rows = vectors.where(F.col(vector_column).isNotNull() & F.col(group).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(group).cast("long").alias("g"), _kept(vectors, vector_column).alias("v"), F.lit(0).alias("all"))

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        pdf = pdf.sort_values("g", ignore_index=True)  # rows of a group stand together
        v, one, two = _sides(pdf, x, y)
        ids, g = pdf["id"].to_numpy(), pdf["g"].to_numpy()
        other, theirs = v[two].T, g[two]
        out = []

        def told(i: np.ndarray, j: np.ndarray, similarity: np.ndarray) -> None:
            r = np.round(similarity, 6)
            at = _first(i, r, ids[j])
            out.append((i[at], j[at], r[at]))

        for lo in range(0, len(one), TILE):
            mine = one[lo : lo + TILE]
            s = v[mine] @ other
            for k in np.unique(g[mine]):
                a, b = np.searchsorted(g[mine], [k, k + 1])
                c, d = np.searchsorted(theirs, [k, k + 1])
                s[a:b, c:d] = -np.inf
            # All that may round to the best: a unit of the last place below it.
            i, j = np.nonzero(s >= np.maximum(s.max(axis=1, initial=-np.inf), -2)[:, None] - 2.1 * HALF)
            told(mine[i], two[j], s[i, j])
            if x != y:
                i, j = np.nonzero(s >= np.maximum(s.max(axis=0), -2)[None, :] - 2.1 * HALF)
                told(two[j], mine[i], s[i, j])
                if len(out) > 32:  # one match a row is enough
                    i, j, r = (np.concatenate(c) for c in zip(*out, strict=True))
                    at = _first(i, r, ids[j])
                    out[:] = [(i[at], j[at], r[at])]
        if not out:
            return pd.DataFrame({"id": [], "g": [], "best_id": [], "best_g": [], "similarity": []})
        i, j, r = (np.concatenate(c) for c in zip(*out, strict=True))
        at = _first(i, r, ids[j])
        i, j, r = i[at], j[at], r[at]
        return pd.DataFrame({"id": ids[i], "g": g[i], "best_id": ids[j], "best_g": g[j], "similarity": r})

    found = _cells(rows, "all", block).groupBy("all", "x", "y").applyInPandas(best, "id long, g long, best_id long, best_g long, similarity double")
    pick = F.max(F.struct("similarity", (-F.col("best_id")).alias("n"), "best_g")).alias("b")
    return found.groupBy("id", "g").agg(pick).select(F.col("id").alias(id_column), F.col("g").alias(group), (-F.col("b.n")).alias("best_id"), F.col("b.best_g").alias("best_group"), F.col("b.similarity").alias("similarity"))


def misfiled(nearest: DataFrame, document: str, least: float, share: float = MISFILED) -> DataFrame:
    """Documents whose chunks have a near duplicate elsewhere in at least `share` of cases, and where most of them are."""
    hit = F.col("similarity") >= least
    rows = nearest.groupBy(document).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_near"))
    where = nearest.where(hit).groupBy(document, "best_group").agg(F.count("*").alias("c")).groupBy(document).agg(F.max(F.struct("c", (-F.col("best_group")).alias("m"))).alias("t"))
    ratio = F.col("n_near") / F.col("n")
    return rows.join(where, document, "left").select(document, "n", "n_near", F.round(ratio, 6).alias("share"), (-F.col("t.m")).alias("target"), (ratio >= share).alias("misfiled"))


def contradictions(pairs: DataFrame, label: str = "label", probability: str = "probability", overlap: str = "overlap", code: str = "is_code") -> DataFrame:
    """The funnel before and after an outside judge: enough shared words, no code, contradiction sure enough."""
    return pairs.where((F.col(overlap) >= OVERLAP) & ~F.col(code) & (F.col(label) == "contradiction") & (F.col(probability) >= CONTRADICTION))
