"""Document fingerprints: threshold-scaled sketches of shingle hashes."""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstead.llm.common import staged, window_hashes, word_hashes

#: One in so many shingle hashes is below the threshold.
SCALE = 8
#: Words of a shingle.
WORDS = 5
#: Rows drawn for each range of ids, from which the ranges' bounds are told.
DRAWN = 40
#: Code points of a text that order rows of one id.
HEAD = 64


def sketch(text: str | None, words: int = WORDS, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct shingle hashes below 2**64 / scale; where none is, the least of all alone, so that no text with words has an empty sketch."""
    return _kept(window_hashes(word_hashes(text), words), scale)


def _kept(hashes: np.ndarray, scale: int) -> np.ndarray:
    if not len(hashes):
        return hashes
    below = hashes[hashes < np.uint64((1 << 64) // scale)]
    return np.unique(below) if len(below) else hashes.min(keepdims=True)


def encode_sketch(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u8").tobytes()).decode()


def decode_sketch(code: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(code), "<u8").astype(np.uint64)


def merge_sketches(*sketches: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of the union of the documents' shingles, exactly."""
    return _kept(np.unique(np.concatenate(sketches)), scale) if sketches else np.empty(0, np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has, however unequal they are."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else float(not len(b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _edited(words: int, scale: int):
    def edit(batches):
        done: tuple | None = None  # the row whose next is awaited
        rows: list[list] = [[], [], [], [], [], [], []]

        def out():
            batch = pa.record_batch(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), *(pa.array(x, pa.string()) for x in rows[2:5]), *(pa.array(x, pa.float64()) for x in rows[5:])],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            for x in rows:
                x.clear()
            return batch

        def close(next_text: str, next_sketch: np.ndarray) -> None:
            doc_id, text, own = done[:3]
            cut = len(text) // 3
            changed = text[: len(text) - cut] + next_text[:cut]
            its = own if changed == text else sketch(changed, words, scale)
            digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
            for column, x in zip(rows, (doc_id, len(text), digest, encode_sketch(own), encode_sketch(its), likeness(own, its), likeness(own, next_sketch)), strict=True):
                column.append(x)

        for batch in batches:
            for doc_id, text, part, borrowed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "borrowed")), strict=True):
                text = text or ""
                if done and done[3] != part:
                    done = None  # a borrowed row closed that range
                own = sketch(text, words, scale)
                if done:
                    close(text, own)
                done = None if borrowed else (doc_id, text, own, part)
                if len(rows[0]) >= 512:
                    yield out()
        if rows[0]:
            yield out()

    return edit


def neighbour_fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has the last floor(n_chars / 3) code points replaced by
    the first as many (or all) of the next document, in descending doc_id and
    after the last the first. A fingerprint is base64 of the sorted sketch
    (see sketch), empty for texts without words; likeness estimates Jaccard.

    Ranges of ids are dealt out once with their texts, about as many as there
    are shuffle partitions; a range borrows the first document of the next, so
    no order over all rows is needed in one place. The ranges' bounds are told
    from DRAWN keys for each, whatever the number of rows.

    Null texts are empty; null ids come last, as if the smallest; rows with
    equal ids follow each other by their first HEAD code points, then by hash
    and text, and can lie in several ranges; a table of one row is its own
    next. Rows that are equal throughout stay in one range. Texts of any
    length are taken whole. Other columns are ignored, whatever their names;
    an empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("hash"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = _range_of(_bounds(keyed.select("k", "head"), ranges))
    own = keyed.withColumn("part", part("k", "head"))

    first = F.min(F.struct((-1 - F.col("k")).alias("down"), "head", "hash"))  # -1 - k: descending ids, without overflow
    heads = own.groupBy("part").agg(first.alias("x")).select("part", (-1 - F.col("x.down")).alias("k1"), F.col("x.head").alias("head1"), F.col("x.hash").alias("hash1"))
    to = F.coalesce(F.lag("part").over(W.orderBy("part")), F.max("part").over(W.partitionBy()))  # a row for each range
    lend = staged(heads.select("k1", "head1", "hash1", to.alias("to")), "heads")
    lent = rows_of(keyed, lend).groupBy("to").agg(F.min(F.struct("text", "k", "head", "hash", "doc_id")).alias("x"))
    lent = lent.select("x.doc_id", "x.text", "x.k", "x.head", "x.hash", F.col("to").alias("part"), F.lit(1).alias("borrowed"))

    dealt = own.withColumn("borrowed", F.lit(0)).unionByName(lent).repartitionById(ranges, F.col("part").cast("int"))
    dealt = dealt.sortWithinPartitions("part", "borrowed", F.desc("k"), "head", "hash", "text")
    return dealt.select("doc_id", "text", "part", "borrowed").mapInArrow(_edited(words, scale), _SCHEMA)


def rows_of(keyed: DataFrame, lend: DataFrame) -> DataFrame:
    """The rows that lend names by key, a few; lend has a row for each range."""
    same = (F.col("k") == F.col("k1")) & (F.col("hash") == F.col("hash1")) & (F.col("head") == F.col("head1"))
    return keyed.join(lend, same).select("doc_id", "text", "k", "head", "hash", "to")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bounds(keys: DataFrame, ranges: int) -> list[tuple[int, str]]:
    """Keys (k, head) that part the rows in about equal ranges, fewer than there are ranges; they come from DRAWN rows for each range."""
    total = keys.count()
    share = min(1.0, ranges * DRAWN / max(1, total))
    drawn = sorted((-1 - r["k"], r["head"]) for r in keys.sample(share, seed=7).collect())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def _range_of(bounds: list[tuple[int, str]]):
    """The range of a key, counted from the greatest ids on: the number of bounds at or before it."""

    @F.pandas_udf("long")
    def place(k, head):
        import numpy as np
        import pandas as pd

        down, downs = -1 - k.to_numpy(), np.array([b[0] for b in bounds], np.int64)
        at, after = np.searchsorted(downs, down, side="left"), np.searchsorted(downs, down, side="right")
        for i in np.flatnonzero(at != after):  # the id of a bound
            at[i] = bisect.bisect_right(bounds, (int(down[i]), head.iat[i]))
        return pd.Series(at.astype("int64"))

    return place
