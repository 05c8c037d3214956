"""Packing by concatenating and cutting."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import staged, worker_cache

#: Byte to the character that stands for it in byte-level vocabularies: printable ones for themselves, the others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARACTERS = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
_MARKS = ".,!?;:*#$%&|"
#: Marks at the end of what stands between ASCII white space, after a letter or digit: no piece of a tokenizer that parts letters from marks goes over there.
_ENDS = re.compile(rf"[{_MARKS}](?<=[^\W_].)[{_MARKS}]*(?![^ \t-\r])")
_SPACE = re.compile(r"[ \t-\r]+")


class ChunkIds(dict):
    """Token ids of the pieces of texts between ASCII white space, kept up to a bound.

    Most new pieces are letters with marks after them. Where the vocabulary
    lower-cases, parts letters from marks and has byte-level pieces with word
    ends, texts are lower-cased and marks parted first, so that a word is one
    piece however it is written, and such pieces go straight to the
    tokenizer's model; all others go through the whole tokenizer. At the
    bound, pieces become the older part, which is dropped at the next bound
    but for those that came again. The vocabulary must drop white space and
    never join over it.
    """

    #: Pieces that are kept, and as many older ones; a worker keeps them between stages, so both are some 45 MB at most.
    BOUND = 150_000

    def __init__(self, tokenizer: str, kind: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.form = Tokenizer.from_file(tokenizer), {"<u2": "H", "<u4": "I"}[kind]
        self.model = self.tokenizer.model
        self.parts: dict[bytes, bytes] = {}  # the older part
        made = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and made["model"]["end_of_word_suffix"] == "</w>"

    def _ids(self, piece: str) -> bytes:
        if self.by_word and (piece.isalpha() and piece == piece.lower() and unicodedata.is_normalized("NFC", piece) or not piece.strip(_MARKS)):
            plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
            ids = [t.id for t in self.model.tokenize(plain)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.form}", *ids)

    def __missing__(self, raw: bytes) -> bytes:
        value = self.parts.get(raw)
        if value is None:
            value = self._ids(raw.decode("utf-8", "replace"))
        if len(self) >= self.BOUND:
            self.parts = dict(self)
            self.clear()
        self[raw] = value
        return value

    @staticmethod
    def _plain(text: str) -> str | None:
        """text in lower case, with the marks at ends parted; None where the tokenizer might write its letters otherwise."""
        lower = text.lower()
        known = text.isascii() or "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower)
        return _ENDS.sub(r" \g<0>", lower) if known else None

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_word:
            plain = self._plain(text)
            text = " ".join(x if (y := self._plain(x)) is None else y for x in _SPACE.split(text)) if plain is None else plain
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


def _tokenized(tokenizer: str, last_id: int, kind: str):
    def tokenize(batches):
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        known = worker_cache(f"ids:{tokenizer}:{kind}", lambda: ChunkIds(tokenizer, kind))
        end = np.array([last_id], kind).tobytes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                ids = [known.of(x) + end for x in texts[at : at + 256]]
                sizes = [len(x) // np.dtype(kind).itemsize for x in ids]
                starts = start + np.concatenate(([0], np.cumsum(sizes)))
                start = int(starts[-1])
                n = len(ids)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(at, n), pa.array([part] * n, pa.int32()), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "at", "doc_tokens", "ids"],
                )

    return tokenize


def sequence_cuts(first: int, length: int, total: int, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of tokens [first, first + length) of a stream of `total`.

    Sequences are windows of the stream; its last total % window tokens are
    cut at powers of two, largest first, so none needs padding.
    """
    out, at, end, whole = [], first, first + length, total // window * window
    while at < end:
        if at < whole:
            number, low = divmod(at, window)[0], at // window * window
            high = low + window
        else:
            number, low, rest = total // window, whole, total - whole
            while True:
                high = low + (1 << (rest.bit_length() - 1))
                if at < high:
                    break
                rest -= high - low
                low, number = high, number + 1
        stop = min(end, high)
        out.append((at - first, stop - at, number, at - low))
        at = stop
    return out


def _cut(bases: dict[int, int], total: int, window: int, kind: str):
    def cut(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], [], []]
            ids_column = batch.column("ids")
            parts, starts, sizes, names = (batch.column(c).to_pylist() for c in ("part", "at", "doc_tokens", "doc_id"))
            for i, (part, start, size, doc_id) in enumerate(zip(parts, starts, sizes, names, strict=True)):
                ids = np.frombuffer(ids_column[i].as_buffer(), kind).astype("<u4")
                for begin, length, number, offset in sequence_cuts(bases[part] + start, size, total, window):
                    row = (doc_id, begin, length, zlib.crc32(ids[begin : begin + length].tobytes()), size, number, offset)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return cut


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, last_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the tokenizer file, then last_id; null and empty
    texts are last_id alone. The first pass writes ids with their place in
    their partition; the partitions' totals (one number a partition) give
    each a global offset; the second pass cuts the stream at multiples of the
    window, a map without a shuffle. A document over a boundary gets a piece,
    a boundary record, on either side. The rest of the stream is cut at
    powers of two, so nothing is padded.

    Null ids stay; repeated rows are packed as often as they occur; texts of
    any length are whole; other columns are ignored; an empty table gives
    none. Without lost work: the ids are in the shared folder.
    """
    vocabulary = json.loads(open(tokenizer, encoding="utf-8").read())
    largest = max([last_id, *vocabulary["model"]["vocab"].values(), *(t["id"] for t in vocabulary.get("added_tokens", []))])
    kind = "<u2" if largest < 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = staged(rows.mapInArrow(_tokenized(tokenizer, last_id, kind), "doc_id long, part int, at long, doc_tokens long, ids binary"), "ids")
    bases, total = {}, 0
    for part, tokens in sorted(tuple(r) for r in ids.groupBy("part").agg(F.sum("doc_tokens")).collect()):
        bases[part] = total
        total += tokens
    return ids.mapInArrow(_cut(bases, total, window, kind), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
