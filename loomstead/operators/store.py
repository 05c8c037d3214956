"""Chunk stores as tables: lookup, lists, deletion, change, and building an index from files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.functions import chunkers, text
from loomstead.operators.knowledge import diff_states


def lookup(rows: DataFrame, key, id_col: str = "id") -> DataFrame:
    """The row with this id; LookupError where there is none, and for a null id. Of rows that share it, the first by their columns as JSON."""
    found = rows.where(F.col(id_col) == F.lit(key))
    order = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    first = found.agg(F.min_by(F.struct(*rows.columns), order).alias("x")).first()["x"]  # one row, read once
    if first is None:
        raise LookupError(f"no row with {id_col} {key}")
    return rows.sparkSession.createDataFrame([first], rows.schema)


def indexed_files(chunks: DataFrame) -> DataFrame:
    """(file_path): every file that has a chunk, once; null paths are none."""
    return chunks.where(F.col("file_path").isNotNull()).select("file_path").distinct()


def summaries(chunks: DataFrame, file_path: str | None = None) -> DataFrame:
    """(id, content_hash, name, start_line) of a file's chunks, or of all, by file, place and id."""
    rows = chunks if file_path is None else chunks.where(F.col("file_path") == file_path)
    return rows.orderBy("file_path", "start_line", "id").select("id", "content_hash", "name", "start_line")


def _named(ids: DataFrame | None, file_path: str | None, domain: str | None) -> Column | None:
    test = None
    for name, value in (("file_path", file_path), ("domain", domain)):
        if value is not None:
            here = F.col(name) == value
            test = here if test is None else test & here
    if test is None and ids is None:
        raise ValueError("name ids, a path or a domain")
    return test


def deleted(rows: DataFrame, ids: DataFrame | None = None, file_path: str | None = None, domain: str | None = None, id_col: str = "id") -> DataFrame:
    """rows without those of the ids (a table with id_col), the path and the domain, all that are given at once; nulls are never named."""
    test = _named(ids, file_path, domain)
    if ids is None:
        return rows.where(~F.coalesce(test, F.lit(False)))
    gone = ids.select(F.col(id_col).alias("_gone")).where("_gone is not null").distinct()
    if test is None:
        return rows.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    return rows.join(gone, (F.col(id_col) == F.col("_gone")) & F.coalesce(test, F.lit(False)), "left_anti")


def cleared(rows: DataFrame) -> DataFrame:
    """The store without its rows."""
    return rows.limit(0)


def updated(rows: DataFrame, changes: dict[str, Column], ids: DataFrame | None = None, file_path: str | None = None, domain: str | None = None, id_col: str = "id") -> DataFrame:
    """rows with columns changed in those of the ids, the path and the domain, all that are given at once. Null ids, paths and domains are never named; ids given twice count once; repeated rows all change."""
    test = _named(ids, file_path, domain)
    hit = F.lit(True) if test is None else F.coalesce(test, F.lit(False))
    told = rows.withColumn("_hit", F.lit(True))
    if ids is not None:
        mine = ids.select(F.col(id_col).alias("_mine")).distinct().withColumn("_hit", F.lit(True))
        told = rows.join(mine, F.col(id_col) == F.col("_mine"), "left").drop("_mine")
    told = told.withColumn("_hit", F.coalesce("_hit", F.lit(False)) & hit)
    return told.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_hit")


def built(files: DataFrame, embed: Callable[[Column], Column] | None = None, domain: str = "default") -> DataFrame:
    """Chunks of files (path, text) as a store: id, file_path, type, name, content, start_line, end_line, language, domain, content_hash[, embedding].

    Files are chunked, each chunk is named, hashed and, where an embedder is
    given, embedded with its kind and place. Null texts give no chunks.
    """
    rows = chunkers.chunk_files(files).withColumnRenamed("path", "file_path")
    out = rows.withColumns({
        "id": text.chunk_id(F.col("file_path"), F.col("name"), F.col("start_line")), "domain": F.lit(domain), "content_hash": F.sha2("content", 256),
    })
    if embed is None:
        return out
    told = text.enriched(F.col("language"), F.col("type"), F.col("name"), F.col("file_path"), F.col("content"))
    return out.withColumn("embedding", embed(told))


def refreshed(chunks: DataFrame, states: DataFrame, files: DataFrame, embed: Callable[[Column], Column] | None = None, domain: str = "default") -> tuple[DataFrame, DataFrame]:
    """(chunks, states) after files (path, text) changed: only new and changed files are chunked and embedded, chunks of deleted ones go.

    states has file_path and content_hash of what is indexed.
    """
    now = files.select(F.col("path").alias("file_path"), F.sha2("text", 256).alias("content_hash"))
    change = diff_states(states, now)
    fresh = files.join(change.where("change in ('added', 'changed')").select(F.col("file_path").alias("path")), "path", "left_semi")
    kept = chunks.join(change.where("change = 'same'").select("file_path"), "file_path", "left_semi")
    return kept.unionByName(built(fresh, embed, domain).select(*chunks.columns)), now
