"""Registered queries over stores that are changed in place, streams with state, side indexes, vector indexes, and in SQL alone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomstead.functions import scopes, table_functions
from loomstead.operators import vector_index
from loomstead.operators.bucket_store import BucketStore
from loomstead.operators.lexical import bm25_from_postings
from loomstead.operators.side_index import SideIndex
from loomstead.plans.catalogue import CHUNKS_SQL, SQL, bm25_sql, documents, embeddings, log_of, query, r, t
from loomstead.plans.more import of, s, small_files
from loomstead.plans.staging import file_system, folder
from loomstead.streaming import reindex, retrieval, tracking


def own_folder(spark, name: str) -> str:
    """A folder of the shared one for a query's store; it goes when the driver ends."""
    path = f"{folder(spark)}/loomstead-{name}-{uuid.uuid4().hex}"
    system, at = file_system(spark, path)
    system.mkdirs(at)
    system.deleteOnExit(at)
    return path


# --- a store of chunks ----------------------------------------------------------------------------------------------------

FIRST, SECOND = "2024-01-01", "2024-02-01"
#: Documents go in but for the shortest; short ones are put over or added, good ones renamed, toxic ones, a language and a source deleted.
CHANGED_SQL = f"""i AS (SELECT doc_id AS id, lang AS domain, source AS file_path, md5(text) AS content_hash, '{FIRST}' AS created_at, n_chars FROM documents WHERE n_chars >= 300),
u AS (SELECT coalesce(i.id, d.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN i.domain ELSE d.lang END AS domain, CASE WHEN d.doc_id IS NULL THEN i.file_path ELSE d.source END AS file_path,
 CASE WHEN d.doc_id IS NULL THEN i.content_hash ELSE md5(d.text || 'x') END AS content_hash, coalesce(i.created_at, '{SECOND}') AS created_at FROM i FULL JOIN (SELECT * FROM documents WHERE n_chars < 900) d ON i.id = d.doc_id),
g AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1), x AS (SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1),
e AS (SELECT id, CASE WHEN id IN (SELECT id FROM g) THEN upper(domain) ELSE domain END AS domain, file_path, content_hash, created_at FROM u),
k AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM x)), f AS (SELECT * FROM k WHERE domain IS DISTINCT FROM 'de'), z AS (SELECT * FROM f WHERE file_path IS DISTINCT FROM 'src3')"""


def changed_store(spark, sf):
    """The store after all changes, and (change, n) of what they returned."""
    d, labels = t(spark, sf, "documents"), t(spark, sf, "labels")
    rows = lambda part, hashed, made: part.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), F.col("source").alias("file_path"), F.md5(hashed).alias("content_hash"), F.lit(made).alias("created_at"))
    chunks = BucketStore(spark, own_folder(spark, "chunks"), "id long, domain string, file_path string, content_hash string, created_at string", buckets=16)
    counts = [("inserted", chunks.insert(rows(d.where("n_chars >= 300"), F.col("text"), FIRST)))]
    put = chunks.upsert(rows(d.where("n_chars < 900"), F.concat("text", F.lit("x")), SECOND))
    counts += [("put over", put["updated"]), ("added", put["inserted"])]
    good = labels.where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    counts.append(("updated", chunks.update(chunks.rows(good).select("id", F.upper("domain").alias("domain")))))
    counts.append(("deleted", chunks.delete(labels.where("toxic = 1").select(F.col("doc_id").alias("id")))))
    counts.append(("of a domain", chunks.delete_where("domain", "de")))
    counts.append(("of a path", chunks.delete_where("file_path", "src3")))
    return chunks, counts


@query(f"WITH {CHANGED_SQL} SELECT id, domain, file_path, content_hash, created_at FROM z")
def store_changed(spark, sf):
    return changed_store(spark, sf)[0].rows()


@query(f"""WITH {CHANGED_SQL} SELECT 'inserted' AS change, (SELECT count(*) FROM i) AS n UNION ALL SELECT 'put over', (SELECT count(*) FROM i WHERE n_chars < 900) UNION ALL SELECT 'added', (SELECT count(*) FROM documents WHERE n_chars < 300)
UNION ALL SELECT 'updated', (SELECT count(*) FROM u WHERE id IN (SELECT id FROM g)) UNION ALL SELECT 'deleted', (SELECT count(*) FROM e) - (SELECT count(*) FROM k) UNION ALL SELECT 'of a domain', (SELECT count(*) FROM k WHERE domain = 'de')
UNION ALL SELECT 'of a path', (SELECT count(*) FROM f WHERE file_path = 'src3') UNION ALL SELECT 'cleared', (SELECT count(*) FROM z) UNION ALL SELECT 'left', 0""")
def store_change_counts(spark, sf):
    chunks, counts = changed_store(spark, sf)
    counts.append(("cleared", chunks.clear()))
    counts.append(("left", chunks.rows().count()))
    return spark.createDataFrame(counts, "change string, n long")


# --- streams with state ---------------------------------------------------------------------------------------------------


@query("SELECT user_id::VARCHAR AS memory_id, count(*) AS n, round(avg(value), 6) AS avg_score, max(ts) AS last FROM events GROUP BY 1")
def tracked_retrievals(spark, sf):
    """The log as a stream in two runs; the second starts where the first stopped, and half of its rows were delivered before."""
    log = log_of(spark, sf).withColumn("memory_id", s("memory_id"))
    at = own_folder(spark, "tracking")
    stream = lambda: retrieval.read_log(spark, f"{at}/log/*")
    log.where("score < 60").write.parquet(f"{at}/log/first")
    tracking.run_tracking(stream(), f"{at}/stats", f"{at}/checkpoint")
    log.where("score >= 30").write.parquet(f"{at}/log/second")
    tracking.run_tracking(stream(), f"{at}/stats", f"{at}/checkpoint")
    return tracking.tracked(spark, f"{at}/stats").select("memory_id", "n", r("avg_score"), F.col("last").cast("timestamp_ntz").alias("last"))


@query("""WITH f AS (SELECT p_partkey || '.md' AS file_path, CASE WHEN p_size > 25 THEN '# ' || p_brand || chr(10) || p_type ELSE '# ' || p_name || chr(10) || 'size ' || p_size END AS text FROM part WHERE p_size <= 40)
SELECT file_path, string_split(text, chr(10))[1][3:] AS name, sha256(text) AS content_hash, sha256(text) AS file_hash FROM f""")
def store_reindexed(spark, sf):
    """Files come as a stream: all, then those that changed or went, then that batch once more by its number."""
    at = own_folder(spark, "reindex")
    chunks = BucketStore(spark, f"{at}/store", reindex.CHUNKS, key="file_path", buckets=8)
    p = small_files(spark, sf).withColumn("version", F.lit(1))
    new = t(spark, sf, "part").where("p_size > 25").select(of(s("p_partkey"), ".md").alias("path"), F.when(F.col("p_size") <= 40, of("# ", F.col("p_brand"), "\n", F.col("p_type"))).alias("text"), F.lit(2).alias("version"))
    stream = lambda: spark.readStream.schema("path string, text string, version int").parquet(f"{at}/files/*")
    for name, rows in (("first", p.select("path", "text", "version")), ("second", new)):
        rows.write.parquet(f"{at}/files/{name}")
        reindex.reindex(stream(), chunks, f"{at}/checkpoint").awaitTermination()
    if chunks.once("batch-1", lambda: reindex.apply_files(chunks, p)):
        raise RuntimeError("a batch was applied twice")
    return chunks.rows().select("file_path", "name", "content_hash", "file_hash")


# --- indexes ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {bm25_sql(['the', 'est'])} SELECT id, round(score, 6) AS score FROM bm")
def side_index_repaired(spark, sf):
    """Postings of a tenth of the documents are lost, others counted wrong; the buckets concerned are built again, and the index answers as a fresh one."""
    docs = documents(spark, sf).select("id", "text")
    index = SideIndex(spark, own_folder(spark, "side"), buckets=16)
    index.build(docs)
    worse = index.postings([1, 5, 9]).where("id % 10 <> 0").withColumn("tf", F.when(F.col("id") % 7 == 0, F.col("tf") + 1).otherwise(F.col("tf")))
    worse.write.parquet(f"{index.path}/worse")
    spark.read.parquet(f"{index.path}/worse").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{index.path}/postings")
    if not 1 <= index.repair(docs) <= 3 or index.check(docs).where("state <> 'whole'").count():
        raise RuntimeError("the index was not mended where it was damaged")
    lengths = index.postings().groupBy("id").agg(F.sum("tf").alias("length"))
    stats = docs.select("id").join(lengths, "id", "left").select("id", F.coalesce("length", F.lit(0)).alias("length"))
    return bm25_from_postings(index.postings().select("term", "id", "tf"), stats, "the est").select("id", r("score"))


def asked_vectors(spark, sf):
    """Queries: every vector whose id is divisible by 50."""
    return embeddings(spark, sf).where("id % 50 = 0").select(F.col("id").alias("q"), F.col("embedding").alias("vector"))


def vector_lists(spark, sf):
    return vector_index.VectorIndex.build(embeddings(spark, sf), own_folder(spark, "vectors"))


def approximate(index, asked):
    """Three of four lists, as the vectors of the tables lie in no clusters, and of each the 30 rows that the codes prefer."""
    return index.search(asked, k=10, probes=max(1, round(0.75 * len(index.centroids))), rerank=30)


@query()
def ann_topk(spark, sf):
    return approximate(vector_lists(spark, sf), asked_vectors(spark, sf)).select("q", "id", r("score"), "rank")


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark, sf):
    """Whether the index finds nine tenths of the ten nearest of all queries, told by all lists without a choice by codes."""
    index, asked = vector_lists(spark, sf), asked_vectors(spark, sf)
    exact = index.search(asked, k=10, probes=len(index.centroids), rerank=0)
    return vector_index.recall(approximate(index, asked), exact).select("queries", (F.col("recall") >= 0.9).alias("enough"))


# --- code -------------------------------------------------------------------------------------------------------------------

#: A file's lines by extension: %c, %n and %k are the row's class name, key and comments; type, name, and first and last line, from those comments on.
SOURCES = {
    "php": ["<?php", "%k", "class %c {", "  function open%n() {", "    return $this->lid('}') . helper%n(1);", "  }", "  function lid() { return 1; }", "}", "function helper%n($v) { return $v; }"],
    "py": ["%k", "class %c:", "    def open%n(self):", "        return self.lid('x(') + helper%n(1)  # fake(", "", "    def lid(self): return 1", "def helper%n(v): return v"],
    "go": ["package a", "%k", "func (c *%c) open%n() int {", '\treturn c.lid("{") + helper%n(1) // fake(', "}", "type %c struct {", "}", "func (c %c) lid(s string) int { return 1 }", "func helper%n(v int) int { return v }"],
}
CODE_SQL = """c AS (SELECT p_partkey AS n, replace(p_brand, '#', '') AS c, p_size % 5 AS k, ['php', 'py', 'go'][(p_size % 3 + 1)::INT] AS ext FROM part),
s(ext, type, under, stem, own, start, stop) AS (VALUES ('php', 'struct', false, '', false, 2, 7), ('php', 'method', true, 'open', true, 3, 5), ('php', 'method', true, 'lid', false, 6, 6), ('php', 'function', false, 'helper', true, 8, 8),
 ('py', 'struct', false, '', false, 1, 5), ('py', 'method', true, 'open', true, 2, 3), ('py', 'method', true, 'lid', false, 5, 5), ('py', 'function', false, 'helper', true, 6, 6),
 ('go', 'method', true, 'open', true, 2, 4), ('go', 'struct', false, '', false, 5, 6), ('go', 'method', true, 'lid', false, 7, 7), ('go', 'function', false, 'helper', true, 8, 8)),
d AS (SELECT n || '.' || ext AS path, CASE WHEN stem = '' THEN c ELSE stem || CASE WHEN own THEN n::VARCHAR ELSE '' END END AS name, CASE WHEN under THEN c ELSE '' END AS parent, type, k + start AS start_line, k + stop AS end_line, ext, c, n FROM c JOIN s USING (ext))"""


def source_files(spark, sf):
    """A file for each part, whose names, length and language come from its columns."""
    p = t(spark, sf, "part").select("p_partkey", F.regexp_replace("p_brand", "#", "").alias("c"), (F.col("p_size") % 5).alias("k"), F.element_at(F.array(*[F.lit(x) for x in SOURCES]), (F.col("p_size") % 3 + 1).cast("int")).alias("ext"), "p_name")
    told = None
    for ext, lines in SOURCES.items():
        mark = "#" if ext == "py" else "//"
        made = F.replace(F.replace(F.lit("\n".join(lines)), F.lit("%c"), F.col("c")), F.lit("%n"), s("p_partkey"))
        made = F.replace(made, F.lit("%k\n"), F.repeat(of(f"{mark} def class func() {{ ", F.col("p_name"), "\n"), F.col("k")))
        told = F.when(F.col("ext") == ext, made) if told is None else told.when(F.col("ext") == ext, made)
    return p.select(of(s("p_partkey"), ".", F.col("ext")).alias("path"), told.alias("text"))


@query(f"WITH {CODE_SQL} SELECT path, CASE WHEN parent = '' THEN name ELSE parent || '.' || name END AS scope, parent, type, name, start_line::INT AS start_line, end_line::INT AS end_line, (parent <> '')::INT AS depth, CASE ext WHEN 'py' THEN 'python' ELSE ext END AS language FROM d")
def code_scopes(spark, sf):
    return scopes.file_scopes(source_files(spark, sf))


@query(f"""WITH {CODE_SQL} SELECT path, c || '.' || name AS scope, 'calls' AS ref_type, CASE WHEN l THEN CASE ext WHEN 'php' THEN 'this' WHEN 'py' THEN 'self' ELSE 'c' END || '.lid' ELSE 'helper' || n END AS ref_name, CASE WHEN l THEN c || '.lid' ELSE 'helper' || n END AS target, (start_line + 1)::INT AS line
FROM d, (VALUES (true), (false)) v(l) WHERE starts_with(name, 'open')""")
def code_scope_refs(spark, sf):
    return scopes.file_references(source_files(spark, sf))


# --- in SQL alone -----------------------------------------------------------------------------------------------------------


def viewed(spark, sf, *names: str) -> dict[str, str]:
    """The tables as temporary views of names of their own."""
    table_functions.register(spark)
    told = {n: f"loomstead_{n}_{uuid.uuid4().hex}" for n in names}
    for n, view in told.items():
        t(spark, sf, n).createOrReplaceTempView(view)
    return told


@query(CHUNKS_SQL.replace("SELECT doc_id || '.txt' AS path, 'file' AS type, ", "SELECT doc_id, ").replace(", 'text' AS language", ""))
def lateral_chunks(spark, sf):
    of = viewed(spark, sf, "documents")
    return spark.sql(f"SELECT doc_id, name, content, start_line, end_line FROM {of['documents']}, LATERAL text_chunks(text)")


@query(SQL["html_links"])
def lateral_links(spark, sf):
    of = viewed(spark, sf, "pages")
    return spark.sql(f"SELECT page_id, link AS url, words AS text, context, score, position FROM {of['pages']}, LATERAL page_links(html, url)")


@query(CHUNKS_SQL.replace("SELECT doc_id || '.txt' AS path, 'file' AS type, ", "SELECT lang, source, doc_id || '.txt' AS path, 'file' AS type, "))
def table_chunks(spark, sf):
    of = viewed(spark, sf, "documents")
    return spark.sql(f"""SELECT * FROM file_chunks(TABLE(SELECT doc_id || '.txt' AS path, lang, source, text AS body FROM {of['documents']}), text => 'body')""")
