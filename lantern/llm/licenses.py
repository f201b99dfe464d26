"""License scans: sparse TF-IDF cosines to license templates, then inheritance from the nearest ancestor directory.

A file's text is cut at line ends and sentence ends; every run of such pieces is a possible header, so headers may be
wrapped, commented or inside a paragraph. A licence file is compared as a whole too, also with full licence texts. Only
runs that hold a signal are compared: a term of a set that each template is too unlike a text without. Terms are weighted by how many
files of the corpus hold them, counted over all files. A file without a match of its own takes the licence of the
nearest directory above it that has a licence file; that is found by joins of paths, over the distinct directories only.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import cut

# The statements by which texts say what they are licensed under.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-3.0", "Licensed under CC BY-NC 3.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
]
#: Whole licences, which licence files are compared with.
FULL = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
#: Terms of windows that are compared at once.
HELD = 4 << 20
_ENDS, _BLANK = (np.isin(np.arange(256), list(x)) for x in (b".;:!?", b" \t\r\n\v\f"))


def _terms(texts: list[str]) -> list[np.ndarray]:
    out = []
    for part in K.words(pa.array(texts, pa.string()), K.ALNUM, True):
        out += [part.hash[a:b] for a, b in zip(part.row_at[:-1], part.row_at[1:], strict=True)]
    return out


class Templates:
    """Weighted template vectors over the templates' own vocabulary; other terms only lengthen a text's vector."""

    def __init__(self, templates: list[tuple[str, str]], full: list[tuple[str, str]], least: float):
        self.names = [n for n, _ in templates + full]
        self.bags = _terms([t for _, t in templates + full])
        self.headers, self.least = len(templates), least
        self.longest = 2 * max(map(len, self.bags[: self.headers]), default=0)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.bags]))

    def weigh(self, df: np.ndarray, files: int) -> None:
        self.idf = np.log((1 + files) / (1 + df)) + 1
        self.other = float(np.log(1 + files) + 1)
        self.matrix = np.zeros((len(self.vocabulary), len(self.bags)))
        for i, bag in enumerate(self.bags):
            term, n = np.unique(np.searchsorted(self.vocabulary, bag), return_counts=True)
            self.matrix[term, i] = n * self.idf[term]
        self.matrix /= np.maximum(np.sqrt((self.matrix**2).sum(axis=0)), 1e-12)
        # A text without a header's rarest terms has a cosine of at most the root of what its other terms weigh, squared.
        self.signal = np.zeros(len(self.vocabulary), bool)
        for i in range(self.headers):
            order = np.argsort(self.idf, kind="stable")
            rest = np.cumsum(self.matrix[order, i] ** 2)
            self.signal[order[(rest >= self.least**2 - 1e-9) & (self.matrix[order, i] > 0)]] = True

    def number(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def cosines(self, unit: np.ndarray, term: np.ndarray, units: int, columns: int) -> np.ndarray:
        """Cosines of each unit - window or file - given as (unit, term) pairs, with the first templates."""
        v = len(self.vocabulary)
        known = term >= 0
        key, n = np.unique(unit[known] * v + term[known], return_counts=True)
        u, t = key // v, key % v
        w = n * self.idf[t]
        length = np.bincount(u, w * w, units) + np.bincount(unit[~known], minlength=units) * self.other**2
        dots = np.stack([np.bincount(u, w * self.matrix[t, i], units) for i in range(columns)], 1) if columns else np.zeros((units, 0))
        return dots / np.sqrt(np.maximum(length, 1e-12))[:, None]


def _frequencies(templates: Templates):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, files = np.zeros(len(templates.vocabulary), np.int64), 0
        for batch in batches:
            files += len(batch)
            for part in K.words(batch.column("text"), K.ALNUM, True, 2 << 20):
                term = templates.number(part.hash)
                known = term >= 0
                pair = np.unique(part.rows()[known] * len(df) + term[known])
                df += np.bincount(pair % len(df), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(df)), -1], pa.int32()), pa.array([*df.tolist(), files], pa.int64())], names=["term", "n"])

    return run


def _windows(piece: np.ndarray, row: np.ndarray, signal: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of every run of pieces of one row that holds a signal, of `longest` words at most if it has
    several pieces. piece, row: of each word, ascending; signal: of each word."""
    begin = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(piece) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(piece))[: len(begin)]
    here = np.concatenate([[0], np.cumsum(signal)])
    first, last = begin, np.arange(len(begin))
    out = []
    while len(first):
        hit = here[end[last]] > here[first]
        out.append((first[hit], end[last[hit]]))
        more = last + 1 < len(begin)
        first, last = first[more], last[more] + 1
        go = (row[begin[last]] == row[first]) & (end[last] - first <= longest) & (here[np.minimum(first + longest, len(signal))] > here[first])
        first, last = first[go], last[go]
    a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _match(templates):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book: Templates = templates.value
        names = np.array([*book.names, ""], object)
        for batch in batches:
            whole = batch.column("whole").to_numpy(zero_copy_only=False).astype(bool)
            for part in K.words(batch.column("text"), K.ALNUM, True, 2 << 20):
                n = part.hi - part.lo
                term, row = book.number(part.hash), part.rows()
                best, which = np.zeros(n), np.full(n, len(names) - 1)

                def better(owner: np.ndarray, cosine: np.ndarray, best=best, which=which) -> None:
                    if not cosine.size:
                        return
                    top, who = cosine.max(axis=1), cosine.argmax(axis=1)
                    order = np.lexsort((who, -top, owner))  # of equal cosines the first template counts
                    owner, top, who = owner[order], top[order], who[order]
                    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    o, t, w = owner[first], top[first], who[first]
                    up = (t > best[o]) | ((t == best[o]) & (w < which[o]))
                    best[o[up]], which[o[up]] = t[up], w[up]

                data = part.data
                ends = data == 10
                ends[:-1] |= _ENDS[data[:-1]] & _BLANK[data[1:]]
                piece = np.searchsorted(np.flatnonzero(ends), part.start) + row  # texts end pieces too
                a, b = _windows(piece, row, (term >= 0) & book.signal[term] if len(book.signal) else term > 0, book.longest)
                group = np.cumsum(b - a) // HELD
                edges = np.searchsorted(group, np.arange(int(group[-1]) + 2)) if len(a) else []
                for lo, hi in zip(edges, edges[1:], strict=False):
                    size = (b - a)[lo:hi]
                    better(row[a[lo:hi]], book.cosines(np.repeat(np.arange(hi - lo), size), term[K.expand(a[lo:hi], size)], int(hi - lo), book.headers))
                files = np.flatnonzero(whole[part.lo : part.hi])
                of = np.isin(row, files)
                better(files, book.cosines(np.searchsorted(files, row[of]), term[of], len(files), len(book.bags)))
                cols = [batch.column(c).slice(part.lo, n) for c in ("id", "path", "whole")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names[which], pa.string()), pa.array(best)], names=["id", "path", "whole", "license", "cosine"])

    return run


def license_scan(
    files: DataFrame,
    is_license_file: Column,
    least: float = 0.8,
    templates: list[tuple[str, str]] | None = None,
    id_column: str = "doc_id",
    path_column: str = "path",
    text_column: str = "text",
) -> DataFrame:
    """id, path, license, cosine, how (`own`, `inherited` or null) and license_dir of every file.

    license is the template's name with the best cosine over runs of the file's lines and sentences - for a licence file
    over its whole text too, which is also compared with full licence texts unless templates are given - if that is at least `least`. Otherwise it is that of the nearest directory above the file with a licence file
    that has one; a directory with several takes the best cosine's, ties the smallest name's. license_dir is the
    directory it comes from. Without any, license, cosine, how and license_dir are null.

    Paths are parts joined by `/`; the root directory is the empty string. Null paths are files of the root. Null and
    empty texts have no licence of their own. Repeated rows are judged one by one; an empty table gives no rows; other
    columns are not looked at.
    """
    spark = files.sparkSession
    book = Templates(TEMPLATES if templates is None else templates, FULL if templates is None else [], least)
    kind = files.schema[id_column].dataType.simpleString()
    path = F.coalesce(F.col(path_column), F.lit(""))
    rows = files.select(F.col(id_column).alias("id"), path.alias("path"), F.coalesce(is_license_file, F.lit(False)).alias("whole"), F.col(text_column).cast("string").alias("text"))
    # One number for each term of the templates, whatever the corpus's size.
    counts = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies(book), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    book.weigh(np.array([counts.get(i, 0) for i in range(len(book.vocabulary))], float), counts.get(-1, 0))
    found = rows.mapInArrow(_match(spark.sparkContext.broadcast(book)), f"id {kind}, path string, whole boolean, license string, cosine double")
    own = F.col("cosine") >= least
    # Three branches read this; texts are read once.
    found = cut(found).select("id", "path", "whole", F.when(own, F.col("license")).alias("license"), F.when(own, F.col("cosine")).alias("cosine"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    owners = found.where("whole and license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"))
    owners = owners.select(F.col("dir").alias("above"), F.col("best.license").alias("dir_license"), (-F.col("best.c")).alias("dir_cosine"))
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    # Every file is below the root: its licence, one row, comes as a literal and not as a key that all directories share.
    owners = cut(owners)
    root = owners.where("above = ''").first()
    ladder = found.select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "above")).where("above != ''")
    nearest = ladder.join(owners, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license", "dir_cosine")).alias("up")).select("dir", "up.*")
    out = found.join(nearest, "dir", "left")
    for name, value, kind in (("dir_license", root and root["dir_license"], "string"), ("dir_cosine", root and root["dir_cosine"], "double"), ("above", root and "", "string")):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(kind)))
    mine = F.col("license").isNotNull()
    return out.select(
        F.col("id").alias(id_column),
        F.col("path").alias(path_column),
        F.coalesce("license", "dir_license").alias("license"),
        F.when(mine, F.col("cosine")).otherwise(F.col("dir_cosine")).alias("cosine"),
        F.when(mine, "own").when(F.col("dir_license").isNotNull(), "inherited").alias("how"),
        F.when(mine, F.col("dir")).otherwise(F.col("above")).alias("license_dir"),
    )
