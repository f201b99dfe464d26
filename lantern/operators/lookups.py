"""Rows looked up by key across the tables of a corpus: glossary, claims, chunks, documents, subjects, stored ids, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def glossary_passages(glossary: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Each term with the chunk that it is defined in and that chunk's document; a term whose chunk is another subject's, or
    gone, has no row. glossary: term, definition, subject_id, chunk_id; chunks: subject_id, chunk_id, document_id, ord, text; documents: document_id, path."""
    found = glossary.join(chunks, ["subject_id", "chunk_id"]).join(documents, "document_id")
    return found.select("subject_id", "term", "definition", "chunk_id", "ord", "text", "path")


def repeated_terms(passages: DataFrame) -> DataFrame:
    """subject_id, term, times, definitions and documents of terms that are defined more than once, and whether they conflict:
    definitions that are equal but for capitals are one, and those of one document are its overlap with itself, so only terms with
    two definitions or more of two documents or more do."""
    small = F.lower("definition")
    terms = passages.groupBy("subject_id", "term").agg(
        F.count("*").alias("times"),
        F.sort_array(F.collect_list("definition")).alias("definitions"),
        F.sort_array(F.collect_list("path")).alias("documents"),
        # Two different ones: the first is not the last.
        F.coalesce((F.min(small) != F.max(small)) & (F.min("path") != F.max("path")), F.lit(False)).alias("conflict"),
    )
    return terms.where("times > 1")


def definition_conflicts(passages: DataFrame, raw: bool = False) -> DataFrame:
    """The repeated terms that conflict; `raw` shows all, as how many there would seem to be."""
    terms = repeated_terms(passages)
    return (terms if raw else terms.where("conflict")).drop("conflict")


def cited_passages(asked: DataFrame, claims: DataFrame, chunks: DataFrame, documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """Each (response_id, chunk_id) asked for, with the passage, its document and subject if a claim of that response cites it - one
    row however many do - and `cited`: a passage is shown by its provenance only, so one that isn't cited stays unseen though it exists."""
    key = ["response_id", "chunk_id"]
    proof = claims.select(*key).distinct().withColumn("cited", F.lit(True))
    whole = chunks.join(documents, "document_id").join(subjects, "subject_id").select("chunk_id", "text", "unit", "path", "code", "name")
    seen = asked.select(*key).distinct().join(proof, key).join(whole, "chunk_id")
    out = asked.join(seen, key, "left")
    return out.withColumn("cited", F.coalesce("cited", F.lit(False)))


def stored_ids(candidates: DataFrame, stored: DataFrame, key: tuple[str, ...] = ("path", "ord"), id_column: str = "chunk_id") -> DataFrame:
    """Candidates with the id that the same place - path and order - has where it is stored, null if it isn't there."""
    ids = stored.select(*key, id_column).dropDuplicates(list(key))
    return candidates.join(ids, list(key), "left")


def loadable(chunks: DataFrame, excluded: DataFrame, needed: dict[str, DataFrame], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The chunks to load with all that is looked up for them, and how many of them are left out by reason.

    A chunk that is excluded counts and is left out; one that lacks a row in a needed table (a table a name, each unique by
    `key`) is an error that names the table and the first of them.
    """
    reasons = excluded.select(*key, F.col("reason").alias("__why"))
    marked = chunks.join(reasons, key, "left")
    rows = marked.where("__why is null").drop("__why")
    for name, table in needed.items():
        lost = rows.join(table.select(*key), key, "left_anti")
        if (first := lost.select(*key).orderBy(*key).first()) is not None:
            raise ValueError(f"no {name} of {tuple(first)}")
        rows = rows.join(table, key)
    return rows, marked.where("__why is not null").groupBy(F.col("__why").alias("reason")).agg(F.count("*").alias("n"))


def manifest_append(manifest: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """The manifest and the files that it doesn't name yet, each once; entries that are there stay as they are."""
    new = files.dropDuplicates([key]).join(manifest.select(key), key, "left_anti")
    return manifest.unionByName(new, allowMissingColumns=True)


def _unknown(named: DataFrame, manifest: DataFrame, key: str) -> None:
    if (first := named.join(manifest.select(key), key, "left_anti").orderBy(key).first()) is not None:
        raise ValueError(f"not in the manifest: {first[0]}")


def manifest_rehash(manifest: DataFrame, named: DataFrame, disk: DataFrame, key: str = "path", hash_column: str = "sha256") -> DataFrame:
    """The manifest with the hashes that the named files have on disk, no others, and `changed`; an unknown name is an error."""
    _unknown(named.select(key), manifest, key)
    now = disk.join(named.select(key).distinct(), key).select(key, F.col(hash_column).alias("__now"))
    both = manifest.join(now, key, "left")
    changed = F.col("__now").isNotNull() & ~F.col("__now").eqNullSafe(F.col(hash_column))
    return both.withColumns({"changed": changed, hash_column: F.coalesce("__now", hash_column)}).drop("__now")


def manifest_delist(manifest: DataFrame, named: DataFrame, disk: DataFrame, key: str = "path") -> DataFrame:
    """The manifest without the named files; one that is still on disk, or that it doesn't know, is an error."""
    if (first := named.join(disk.select(key), key, "left_semi").orderBy(key).first()) is not None:
        raise ValueError(f"still on disk: {first[key]}")
    _unknown(named.select(key), manifest, key)
    return manifest.join(named.select(key), key, "left_anti")


def unlisted(disk: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files on disk that the manifest doesn't name."""
    return disk.join(manifest.select(key), key, "left_anti")
