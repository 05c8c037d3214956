"""Table functions for SQL: chunks and links by LATERAL, and chunks of any table of texts with its other columns."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from loomstead.functions import chunkers

for _module in (chunkers, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)  # workers need no installed copy of them

_CHUNK = [StructField(n, IntegerType() if k == "int" else StringType()) for n, k in (c.split() for c in chunkers.CHUNK.split(", "))]


@udtf(returnType="name string, content string, start_line int, end_line int")
class TextChunks:
    """text_chunks(text[, size]): lines packed up to size characters; null and empty texts have none."""

    def eval(self, text: str, size: int = chunkers.SIZES["generic"]):
        if text:
            for _, name, content, start, end in chunkers.generic_chunks(text, size):
                yield name, content, start, end


@udtf(returnType="link string, words string, context string, score int, position int")
class PageLinks:
    """page_links(html, url): the links of a page, resolved against its address and scored; null pages have none."""

    def eval(self, html: str, url: str):
        if html:
            yield from chunkers.page_links(html, url or "")


@udtf
class FileChunks:
    """file_chunks(TABLE(t) [PARTITION BY ...], path => 'column', text => 'column'): a row for each chunk of each row of t, cut by the extension of its path, with t's columns but the text.

    The names of the columns are constants (`path` and `text` by default).
    Chunk columns that t has too come with `chunk_` before their names. Null
    paths are texts without an extension; null and empty texts have no chunk.
    """

    def __init__(self, told: AnalyzeResult | None = None) -> None:
        self.told = told

    @staticmethod
    def analyze(files: AnalyzeArgument, path: AnalyzeArgument | None = None, text: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("file_chunks takes TABLE(...) first")
        path_column, text_column = (a.value if a is not None else d for a, d in ((path, "path"), (text, "text")))
        names = files.dataType.names
        for column in (path_column, text_column):
            if column not in names:
                raise ValueError(f"the table has no column {column}")
        kept = [f for f in files.dataType.fields if f.name != text_column]
        taken = {f.name for f in kept}
        own = [StructField(f"chunk_{f.name}" if f.name in taken else f.name, f.dataType) for f in _CHUNK[1:]]  # without the path, which the table has
        return AnalyzeResult(schema=StructType([*kept, *own]))

    def eval(self, files, path: str = "path", text: str = "text"):
        row = files.asDict()
        content = row.pop(text)
        if content:
            for chunk in chunkers.chunk_text(row[path] or "", content):
                yield (*row.values(), *chunk[1:])


def register(spark: SparkSession) -> None:
    """Make text_chunks, page_links and file_chunks known to spark.sql."""
    for name, function in (("text_chunks", TextChunks), ("page_links", PageLinks), ("file_chunks", FileChunks)):
        spark.udtf.register(name, function)
