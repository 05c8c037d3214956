"""Change-driven re-indexing as a stream: new versions of files go to a store of chunks, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstead.operators import store
from loomstead.operators.bucket_store import BucketStore
from loomstead.plans.staging import staged, unstage
from loomstead.streaming.retrieval import in_batches

#: Columns of a store of chunks that file_hash, the digest of a chunk's file, is added to; the key is file_path.
CHUNKS = "file_path string, id string, type string, name string, content string, start_line int, end_line int, language string, domain string, content_hash string, file_hash string"


def apply_files(chunks: BucketStore, files: DataFrame, embed: Callable[[Column], Column] | None = None, domain: str = "default") -> dict[str, int]:
    """Put files (path, text, version) in the store: {changed, deleted, inserted} of files and chunks.

    Of several versions of a path the greatest counts (of equal ones any). A
    null text deletes the file's chunks; a text whose digest the store has
    changes nothing and is neither chunked nor embedded again. A text without
    chunks leaves the file without any. Null paths are left out.
    """
    latest = files.where("path is not null").groupBy("path").agg(F.max_by(F.struct("text"), "version").alias("x"))
    latest = latest.select("path", "x.text", F.sha2("x.text", 256).alias("now"))
    latest = staged(latest, "files")
    keys = latest.select(F.col("path").alias("file_path"))
    held = chunks.rows(keys).groupBy("file_path").agg(F.min("file_hash").alias("before"))
    told = latest.join(held, F.col("path") == F.col("file_path"), "left").where(~F.col("now").eqNullSafe(F.col("before")))
    changed = staged(told.select("path", "text", "now"), "changed")
    built = store.built(changed.where("text is not null").select("path", "text"), embed, domain)
    rows = built.join(changed.select(F.col("path").alias("_p"), F.col("now").alias("file_hash")), F.col("file_path") == F.col("_p"))
    counts = chunks.replace(changed.select(F.col("path").alias("file_path")), rows.select(*chunks.kind.names))
    counts["changed"] = changed.count()
    unstage(latest, changed)
    return counts


def reindex(stream: DataFrame, chunks: BucketStore, checkpoint: str, embed: Callable[[Column], Column] | None = None, domain: str = "default") -> StreamingQuery:
    """Apply every micro-batch of a stream of files (path, text, version) to the store.

    The store's ledger holds the numbers of the batches that are done, so a
    batch that the stream delivers again after a failure changes nothing.
    """
    return in_batches(stream, lambda batch, number: chunks.once(f"batch-{number}", lambda: apply_files(chunks, batch, embed, domain)), checkpoint)
