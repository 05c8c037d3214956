"""Registered queries of the library and their SQL. The driver tables stand in for the stores that the operators are made for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions import chunkers, text
from loomstead.operators import findings, fusion, knowledge, lexical, reports, scoring, search, vectors
from loomstead.sources import files, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vector_of(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    return list(t(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("type"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
LABEL = "CASE WHEN rn <= greatest(1, floor(0.2 * n)) THEN 'high' WHEN rn <= greatest(greatest(1, floor(0.2 * n)), floor(0.7 * n)) OR n <= 3 THEN 'medium' ELSE 'low' END"


# --- retrieval ---------------------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT e.vec_id AS id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
k AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 10), x AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn, count(*) OVER () AS n FROM k)
SELECT id, round(score, 6) AS score, {LABEL} AS relevance FROM x""")
def vec_topk(spark, sf):
    return search.dense_search(embeddings(spark, sf), vector_of(spark, sf, 0), 10).select("id", r("score"), "relevance")


@query(f"""SELECT e.vec_id AS id, e.label::VARCHAR AS type, round({COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q
WHERE e.label = 1 AND {COS} >= 0.05""")
def vec_threshold_type(spark, sf):
    rows = search.filtered(embeddings(spark, sf), type="1")
    return vectors.top_k(vectors.score_against(rows, vector_of(spark, sf, 1)), 0, threshold=0.05).select("id", "type", r("score"))


@query(f"""WITH s AS (SELECT p.vec_id AS p, e.vec_id AS id, {COS.replace("q.", "p.")} AS score FROM embeddings e, embeddings p WHERE p.vec_id < 5),
x AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, id) AS rn FROM s) SELECT p::VARCHAR AS query, id, round(score, 6) AS score, rn::INT AS rank FROM x WHERE rn <= 7""")
def vec_batch_topk(spark, sf):
    queries = [(str(i), vector_of(spark, sf, i)) for i in range(5)]
    scored = vectors.matrix_scores(embeddings(spark, sf), queries)
    return vectors.top_k_each(scored, ["query"], 7).select("query", "id", r("score"), "rank")


@query(f"""WITH s AS (SELECT e.vec_id AS id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
c AS (SELECT (SELECT median(score) FROM s WHERE id IN (0, 1, 2)) AS perfect, (SELECT median(score) FROM s WHERE id > 2) AS baseline),
h AS (SELECT *, CASE WHEN perfect > baseline THEN baseline + 0.7 * (perfect - baseline) ELSE 0.7 END AS high, CASE WHEN perfect > baseline THEN baseline + 0.4 * (perfect - baseline) ELSE 0.4 END AS medium,
CASE WHEN perfect > baseline THEN baseline + 0.15 * (perfect - baseline) ELSE 0.15 END AS low FROM c)
SELECT CASE WHEN greatest(0, least(1, score)) >= high THEN 'high' WHEN greatest(0, least(1, score)) >= medium THEN 'medium' ELSE 'low' END AS relevance, count(*) AS n,
round(min(high), 6) AS high, round(min(medium), 6) AS medium, round(min(low), 6) AS low FROM s, h GROUP BY 1""")
def vec_calibration(spark, sf):
    scored = vectors.score_against(embeddings(spark, sf), vector_of(spark, sf, 0)).drop("embedding")
    c = scoring.calibrate(scored.where("id in (0, 1, 2)"), scored.where("id > 2"))
    told = scoring.threshold_labels(scored, c).groupBy("relevance").agg(F.count(F.lit(1)).alias("n"))
    return told.crossJoin(F.broadcast(c.select(r("high"), r("medium"), r("low"))))


def bm25_sql(terms: list[str], rank: str = "") -> str:
    parts = " + ".join(f"CASE WHEN tf{i} > 0 THEN greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(terms)))
    tfs = ", ".join(f"len(list_filter(ws, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    held = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""bw AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents), bc AS (SELECT id, len(ws) AS dl, {tfs} FROM bw),
bf AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM bc), bm AS (SELECT id, {parts} AS score FROM bc, bf WHERE {held})"""


@query(f"WITH {bm25_sql(['the', 'est'])} SELECT id, round(score, 6) AS score FROM bm ORDER BY score DESC, id LIMIT 10")
def bm25_topk(spark, sf):
    return vectors.top_k(lexical.bm25(documents(spark, sf), "the est"), 10).select("id", r("score"))


@query(f"WITH {bm25_sql(['the', 'est'])} SELECT id, round(score, 6) AS score FROM bm")
def bm25_postings(spark, sf):
    postings, stats = lexical.build_postings(documents(spark, sf))
    return lexical.bm25_from_postings(postings, stats, "the est").select("id", r("score"))


DENSE_SQL = f"dn AS (SELECT e.vec_id AS id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 40), lx AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT 40)"


def two_lists(spark, sf):
    dense = vectors.top_k(vectors.score_against(embeddings(spark, sf), vector_of(spark, sf, 0)), 40).select("id", "score")
    return dense, vectors.top_k(lexical.bm25(documents(spark, sf), "the of"), 40)


@query(f"""WITH {bm25_sql(["the", "of"])}, {DENSE_SQL}, p AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM dn UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM lx),
s AS (SELECT id, sum(part) AS score FROM p GROUP BY id ORDER BY score DESC, id LIMIT 10), x AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn, count(*) OVER () AS n FROM s) SELECT id, round(score, 8) AS score, {LABEL} AS relevance FROM x""")
def hybrid_rrf(spark, sf):
    return search.hybrid_search(*two_lists(spark, sf), 10).select("id", r("score", 8), "relevance")


@query(f"""WITH {bm25_sql(["the", "of"])}, {DENSE_SQL}, p AS (SELECT id, 0.6 * score AS part FROM dn UNION ALL SELECT id, 0.4 * score FROM lx)
SELECT id, round(sum(part), 6) AS score FROM p GROUP BY id ORDER BY sum(part) DESC, id LIMIT 15""")
def hybrid_weighted(spark, sf):
    return search.hybrid_search(*two_lists(spark, sf), 15, "weighted", 0.6).select("id", r("score"))


@query(f"""SELECT e.vec_id AS id, round({COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q
WHERE e.vec_id IN (SELECT doc_id FROM documents WHERE contains(text, 'and')) ORDER BY {COS} DESC, e.vec_id LIMIT 12""")
def prefilter_dense(spark, sf):
    allowed = documents(spark, sf).where(F.contains("text", F.lit("and"))).select("id")
    return search.prefilter_search(embeddings(spark, sf), allowed, vector_of(spark, sf, 3), 12).select("id", r("score"))


def three_queries(spark, sf):
    names = ["a", "b", "c"]
    hits = vectors.matrix_scores(embeddings(spark, sf), [(n, vector_of(spark, sf, i)) for i, n in enumerate(names)])
    return vectors.top_k_each(hits, ["query"], 30).drop("rank"), names


MULTI_SQL = f"""WITH s AS (SELECT chr(97 + p.vec_id::INT) AS query, e.vec_id AS id, e.label, {COS.replace("q.", "p.")} AS score FROM embeddings e, embeddings p WHERE p.vec_id < 3),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn FROM s) WHERE rn <= 30),
m AS (SELECT id, any_value(label) AS label, max(score) AS base, least(1.0, max(score) + 0.05 * (count(DISTINCT query) - 1)) AS score, array_to_string(list_sort(list(DISTINCT query)), ',') AS matched FROM h GROUP BY id)"""


@query(MULTI_SQL + " SELECT id, round(base, 6) AS base, round(score, 6) AS score, matched FROM m ORDER BY m.score DESC, id LIMIT 20")
def multisearch_boost(spark, sf):
    return fusion.multisearch(*three_queries(spark, sf), limit=20).select("id", r("base"), r("score"), F.array_join("matched", ",").alias("matched"))


@query(MULTI_SQL + " SELECT h.query, h.id, round(m.score, 6) AS score FROM h JOIN m USING (id)")
def multisearch_by_query(spark, sf):
    hits, names = three_queries(spark, sf)
    return fusion.by_query(fusion.multisearch(hits, names), names).select("query", "id", r("score"))


@query(MULTI_SQL + " SELECT CASE WHEN label = 0 THEN 'default' ELSE label::VARCHAR END AS collection, count(*) AS n, round(max(score), 6) AS best FROM m GROUP BY 1")
def multisearch_by_collection(spark, sf):
    hits, names = three_queries(spark, sf)
    domain = embeddings(spark, sf).select("id", F.when(F.col("type") == "0", "").otherwise(F.col("type")).alias("domain"))
    told = fusion.by_collection(fusion.multisearch(hits, names).join(domain, "id"))
    return told.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"))


@query(MULTI_SQL.replace("\nm AS", "\nm0 AS") + " SELECT id, round(max(score), 6) AS score FROM h GROUP BY id")
def profile_union(spark, sf):
    hits, names = three_queries(spark, sf)
    return fusion.max_union([hits.where(F.col("query") == n) for n in names]).select("id", r("score"))


@query(f"""WITH s AS (SELECT e.vec_id AS id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), c AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 50)
SELECT id, round((id % 17) / 17.0::DOUBLE, 6) AS score FROM c WHERE (id % 17) / 17.0::DOUBLE >= 0.3 ORDER BY (id % 17) DESC, id LIMIT 10""")
def rerank_cut(spark, sf):
    fetched = vectors.top_k(vectors.score_against(embeddings(spark, sf), vector_of(spark, sf, 0)), search.over_fetch(10, "rerank"))
    return search.rerank(fetched, (F.col("id") % 17) / F.lit(17.0), 10, 0.3).select("id", r("score"))


def aged(spark, sf):
    return t(spark, sf, "events").select("event_id", F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("at")), F.to_timestamp(F.lit(AS_OF))


@query(f"SELECT event_id, round(value * (1 + 0.5 * exp(-greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0 / 7)), 5) AS score FROM events")
def recency_boost(spark, sf):
    rows, as_of = aged(spark, sf)
    return rows.select("event_id", F.round(scoring.recency_boost(F.col("score"), F.col("at"), as_of), 5).alias("score"))


@query(f"SELECT event_id, round(value * exp(-ln(2) / 90 * greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0), 5) AS score FROM events")
def temporal_decay(spark, sf):
    rows, as_of = aged(spark, sf)
    return rows.select("event_id", F.round(scoring.temporal_decay(F.col("score"), F.col("at"), as_of), 5).alias("score"))


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS files, max(n_chars) AS newest FROM documents")
def index_stats(spark, sf):
    return documents(spark, sf).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("files"), F.max("n_chars").alias("newest"))


@query("SELECT doc_id AS id, source, n_chars FROM documents WHERE lang = 'en' AND lower(source) LIKE 'src1%' ORDER BY source, doc_id LIMIT 50 OFFSET 5")
def chunk_scan(spark, sf):
    rows = documents(spark, sf).withColumnRenamed("source", "file_path").withColumnRenamed("lang", "language")
    out = search.filtered(rows, language="en", path_prefix="src1", parity=True).orderBy("file_path", "id").offset(5).limit(50)
    return out.select("id", F.col("file_path").alias("source"), "n_chars")


@query("SELECT vec_id AS id, len(embedding)::INT AS dims FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def embedding_fetch(spark, sf):
    ids = documents(spark, sf).where("lang = 'de'").select("id")
    return embeddings(spark, sf).join(ids, "id", "left_semi").select("id", F.size("embedding").alias("dims"))


@query("""WITH q AS (SELECT vec_id AS id, embedding::FLOAT[] AS e, list_min(embedding::FLOAT[]) AS lo, list_max(embedding::FLOAT[]) AS hi FROM embeddings),
s AS (SELECT *, CASE WHEN hi = lo THEN 1::FLOAT ELSE ((hi - lo) / 254.0::DOUBLE)::FLOAT END AS scale FROM q)
SELECT id, len(e)::INT AS dims, max_err <= scale * 1.01 AS within FROM (SELECT *, list_max(list_transform(e, lambda x: abs((trunc(greatest(-127, least(127, (x - lo)::DOUBLE / scale - 127))) + 127) * scale + lo - x))) AS max_err FROM s)""")
def quantise_roundtrip(spark, sf):
    rows = embeddings(spark, sf).withColumn("c", vectors.quantise(F.col("embedding")))
    error = F.array_max(F.zip_with(vectors.dequantise(F.col("c")), "embedding", lambda a, b: F.abs(a - b)))
    return rows.select("id", F.size("embedding").alias("dims"), (error <= F.col("c.scale") * 1.01).alias("within"))


@query("SELECT vec_id AS id, len(embedding)::INT * 4 AS bytes, true AS same FROM embeddings")
def vector_codec(spark, sf):
    rows = embeddings(spark, sf).withColumn("b", vectors.encode_vector("embedding"))
    return rows.select("id", F.length("b").alias("bytes"), (vectors.decode_vector("b") == F.col("embedding")).alias("same"))


@query("SELECT label::VARCHAR AS type, len(list(x))::INT AS dims, round(sum(x), 4) AS total FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label")
def mean_pooling(spark, sf):
    pooled = vectors.mean_pool(embeddings(spark, sf), "type")
    return pooled.select("type", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query()
def keyword_embed_search(spark, sf):
    return search.offline_search(documents(spark, sf), "the and of that", 10).select("id", r("score"))


# --- retrieval logs and knowledge ---------------------------------------------------------------------------------------


def log_of(spark, sf):
    return t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("memory_id"), F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("timestamp"))


@query("""SELECT c_custkey AS memory_id, c_mktsegment AS status, count(event_id) AS n, round(avg(value), 6) AS avg_score, max(ts) AS last FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1, 2 HAVING count(event_id) >= 3""")
def retrieval_stats(spark, sf):
    memories = t(spark, sf, "customer").select(F.col("c_custkey").alias("memory_id"), F.col("c_mktsegment").alias("status"))
    return knowledge.retrieval_stats(memories, log_of(spark, sf), 3).select("memory_id", "status", "n", r("avg_score"), F.col("last").cast("timestamp_ntz").alias("last"))


@query("SELECT event_id AS id, round(value, 6) AS score FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 5 OFFSET 1")
def retrieval_history(spark, sf):
    log = log_of(spark, sf)
    return knowledge.retrieval_history(log, log.agg(F.min("memory_id")).first()[0], 5, 1).select("id", r("score"))


@query(f"SELECT count(*) AS kept, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY")
def retrieval_prune(spark, sf):
    return knowledge.prune_log(log_of(spark, sf), F.to_timestamp(F.lit(AS_OF)), 10).agg(F.count(F.lit(1)).alias("kept"), F.min("id").alias("first_id"))


def entries_of(spark, sf):
    p = t(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.col("p_type").alias("answer"), F.split("p_type", " ").alias("tags"), F.when(F.col("p_size") > 25, "pending").otherwise("promoted").alias("status"), F.col("p_size").alias("occurrences"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("last_seen"))


@query("""SELECT p_partkey AS id, p_size AS occurrences FROM part WHERE p_size > 25 AND list_contains(string_split(lower(p_type), ' '), (SELECT lower(string_split(p_type, ' ')[1]) FROM part WHERE p_partkey = 1))
ORDER BY p_size DESC, p_partkey LIMIT 30 OFFSET 3""")
def knowledge_list(spark, sf):
    e = entries_of(spark, sf)
    tag = e.where("id = 1").first()["tags"][0]
    return knowledge.list_entries(e, status="pending", tags=[tag.swapcase()], limit=30, offset=3).select("id", "occurrences")


@query("""WITH o AS (SELECT p_partkey AS id, p_size AS n FROM part WHERE p_partkey % 3 <> 0), w AS (SELECT p_partkey AS id, p_size * 2 AS n FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(w.id, o.id) AS id, coalesce(w.n, o.n) AS n FROM o FULL JOIN w ON o.id = w.id""")
def knowledge_import_merge(spark, sf):
    p = t(spark, sf, "part")
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2).alias("n"))
    return knowledge.import_entries(old, new, "merge")


@query("""SELECT p_partkey AS id, p_size AS n FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_size * 2 FROM part WHERE p_partkey % 6 = 0""")
def knowledge_import_append(spark, sf):
    p = t(spark, sf, "part")
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2).alias("n"))
    return knowledge.import_entries(old, new, "append")


@query("SELECT count(*) FILTER (WHERE p_partkey % 2 = 0) AS processed, count(*) FILTER (WHERE p_partkey % 6 = 0) AS created, count(*) FILTER (WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0) AS existing FROM part")
def knowledge_bulk_counts(spark, sf):
    ids = t(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return knowledge.bulk_counts(ids.where("id % 3 <> 0"), ids.where("id % 2 = 0"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS pending, count(*) FILTER (WHERE p_size <= 25) AS promoted, sum(p_size)::BIGINT AS occurrences, (DATE '2024-01-01' + max(p_size)::INT)::DATE AS last_seen,
(SELECT count(DISTINCT x) FROM (SELECT unnest(string_split(p_type, ' ')) AS x FROM part)) AS n_tags FROM part""")
def knowledge_stats(spark, sf):
    return knowledge.entry_stats(entries_of(spark, sf))


@query("SELECT p_partkey AS id FROM part WHERE DATE '2024-01-01' + p_size::INT < DATE '2024-02-01' - 14")
def knowledge_stale(spark, sf):
    return knowledge.stale_entries(entries_of(spark, sf), F.to_timestamp(F.lit(AS_OF)), 14).select("id")


@query("""WITH w AS (SELECT p_partkey AS id, list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: octet_length(x::BLOB) > 3) AS ws FROM part),
p AS (SELECT a.id AS a, b.id AS b, len(list_filter(a.ws, lambda x: list_contains(b.ws, x))) AS common, least(len(a.ws), len(b.ws)) AS n FROM w a, w b WHERE a.id < b.id AND len(a.ws) > 0 AND len(b.ws) > 0)
SELECT a, b, common::BIGINT AS common FROM p WHERE common > 0 AND common >= 0.5 * n""")
def similar_questions(spark, sf):
    q = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"))
    return knowledge.similar_questions(q)


@query("""WITH w AS (SELECT p_partkey AS id, list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: octet_length(x::BLOB) > 3)) AS ws FROM part),
c AS (SELECT ws, min(id) AS id, count(*) AS held FROM w WHERE len(ws) > 0 GROUP BY ws),
p AS (SELECT a.id AS a, b.id AS b, len(list_filter(a.ws, lambda x: list_contains(b.ws, x))) AS common, least(len(a.ws), len(b.ws)) AS n, a.held AS a_held, b.held AS b_held FROM c a, c b)
SELECT a, b, common::BIGINT AS common, a_held, b_held FROM p WHERE common > 0 AND common >= 0.5 * n""")
def similar_question_classes(spark, sf):
    """Pairs of classes, each shown by its least id, with their sizes: the same as similar_questions without a pair of ids."""
    members, pairs = knowledge.similar_classes(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question")))
    shown = members.groupBy("class").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("held"))
    a, b = (shown.select(F.col("class").alias(f"{x}_class"), F.col("id").alias(x), F.col("held").alias(f"{x}_held")) for x in "ab")
    return pairs.join(a, "a_class").join(b, "b_class").select("a", "b", "common", "a_held", "b_held")


@query("""WITH o AS (SELECT doc_id AS i, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id + 100000000 AS i, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0),
a AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY i) AS k FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY i) AS k FROM n)
SELECT CASE WHEN b.i IS NULL THEN 'delete' WHEN a.i IS NULL THEN 'embed' ELSE 'reuse' END AS action, count(*) AS n, coalesce(sum(a.i), 0)::BIGINT AS olds, coalesce(sum(b.i), 0)::BIGINT AS news FROM a FULL JOIN b ON a.h = b.h AND a.k = b.k GROUP BY 1""")
def chunk_diff(spark, sf):
    d = documents(spark, sf)
    old = d.where("id % 5 <> 0").select("id", text.digest(F.col("text").cast("binary")).alias("hash"))
    changed = F.when(F.col("id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    new = d.where("id % 4 <> 0").select((F.col("id") + 100000000).alias("id"), text.digest(changed.cast("binary")).alias("hash"))
    return knowledge.diff_chunks(old, new).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("old_id"), F.lit(0)).alias("olds"), F.coalesce(F.sum("new_id"), F.lit(0)).alias("news"))


@query("""SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS change, count(*) AS n
FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0) o FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0) n ON o.doc_id = n.doc_id GROUP BY 1""")
def file_state_diff(spark, sf):
    d = documents(spark, sf)
    old = d.where("id % 5 <> 0").select(F.col("id").alias("file_path"), F.md5("text").alias("content_hash"))
    new = d.where("id % 4 <> 0").select(F.col("id").alias("file_path"), F.md5(F.when(F.col("id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("content_hash"))
    return knowledge.diff_states(old, new).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS memory_id, event_id AS id, round(value, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark, sf):
    log = log_of(spark, sf).withColumn("version", F.struct("timestamp", "id"))
    return knowledge.latest(log, "memory_id", "version").select("memory_id", "id", r("score"))


# --- findings -----------------------------------------------------------------------------------------------------------

SEVERITY_SQL = "CASE l_returnflag WHEN 'R' THEN 'CRITICAL' WHEN 'A' THEN 'HIGH' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'MEDIUM' ELSE 'LOW' END END"
BOX_SQL = "CASE WHEN l_linestatus = 'O' THEN '[ ]' WHEN l_linenumber = 1 THEN '[/]' WHEN l_linenumber = 2 THEN '[-]' ELSE '[x]' END"
FINDINGS_SQL = f"""f AS (SELECT l_orderkey * 10 + l_linenumber AS ord, {SEVERITY_SQL} AS severity, {BOX_SQL} AS checkbox, l_quantity * 60 AS est_minutes, (l_suppkey % 7)::VARCHAR AS grp,
CASE WHEN l_tax > 0.04 THEN 'HIGH' ELSE 'LOW' END AS confidence, 'src/' || 'm' || (l_suppkey % 5) || '/f' || (l_partkey % 11) || '.go' AS file, (l_orderkey % 400)::INT AS line FROM lineitem)"""


def finding_rows(spark, sf):
    li = t(spark, sf, "lineitem")
    severity = F.when(F.col("l_returnflag") == "R", "CRITICAL").when(F.col("l_returnflag") == "A", "HIGH").when(F.col("l_linenumber") % 2 == 0, "MEDIUM").otherwise("LOW")
    box = F.when(F.col("l_linestatus") == "O", "[ ]").when(F.col("l_linenumber") == 1, "[/]").when(F.col("l_linenumber") == 2, "[-]").otherwise("[x]")
    path = F.concat(F.lit("src/m"), (F.col("l_suppkey") % 5).cast("string"), F.lit("/f"), (F.col("l_partkey") % 11).cast("string"), F.lit(".go"))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), severity.alias("severity"), box.alias("checkbox"), (F.col("l_quantity") * 60).alias("est_minutes"), (F.col("l_suppkey") % 7).cast("string").alias("group"),
        F.when(F.col("l_tax") > 0.04, "HIGH").otherwise("LOW").alias("confidence"), F.concat(path, F.lit(":"), (F.col("l_orderkey") % 400).cast("string")).alias("file_line"), F.lit("docs").alias("category"), F.lit("2024").alias("section"),
    )


@query(f"WITH {FINDINGS_SQL} SELECT ord, severity, est_minutes FROM f WHERE checkbox = '[ ]' AND est_minutes >= 30 AND est_minutes < 2880 AND grp = '3' AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM') AND confidence = 'HIGH' ORDER BY ord LIMIT 10")
def findings_filter(spark, sf):
    return findings.filter_findings(finding_rows(spark, sf), "backlog", ["critical", "HIGH", "MEDIUM"], ["HIGH"], "3")[0].select("ord", "severity", "est_minutes")


@query(f"""WITH {FINDINGS_SQL} SELECT count(*) AS total, 0::BIGINT AS out_focus, count(*) FILTER (WHERE checkbox <> '[ ]') AS out_unchecked, count(*) FILTER (WHERE checkbox = '[ ]' AND NOT est_minutes < 30) AS out_duration,
0::BIGINT AS out_group, count(*) FILTER (WHERE checkbox = '[ ]' AND est_minutes < 30 AND severity <> 'HIGH') AS out_severity, 0::BIGINT AS out_confidence, count(*) FILTER (WHERE checkbox = '[ ]' AND est_minutes < 30 AND severity = 'HIGH') AS eligible FROM f""")
def findings_filter_counts(spark, sf):
    return findings.filter_findings(finding_rows(spark, sf), "quick", ["HIGH"])[1]


@query(f"WITH {FINDINGS_SQL} SELECT CASE WHEN est_minutes < 30 THEN 'quick_wins' WHEN est_minutes < 2880 THEN 'backlog' ELSE 'td_files' END AS route, count(*) AS n, min(ord) AS first FROM f GROUP BY 1")
def findings_route(spark, sf):
    return findings.route(finding_rows(spark, sf)).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


@query(f"""WITH {FINDINGS_SQL}, g AS (SELECT *, CASE WHEN severity = 'CRITICAL' THEN 'critical' ELSE 'theme:src-' || string_split(file, '/')[2] END AS name FROM f),
s AS (SELECT name AS group_name, count(*) AS n, round(sum(est_minutes), 2) AS minutes FROM g GROUP BY 1) SELECT row_number() OVER (ORDER BY CASE WHEN group_name = 'critical' THEN 1 ELSE 2 END, group_name) AS number, * FROM s""")
def findings_group(spark, sf):
    return findings.group_summary(findings.group_findings(finding_rows(spark, sf))).select("number", "group_name", "n", F.round("minutes", 2).alias("minutes"))


@query(f"""WITH {FINDINGS_SQL} SELECT CASE WHEN grouping(grp) = 1 THEN 'TOTAL' ELSE grp END AS grp, CASE WHEN grouping(severity) = 1 THEN 'TOTAL' ELSE severity END AS severity, count(*) AS n FROM f WHERE checkbox = '[ ]' GROUP BY CUBE (grp, severity)""")
def findings_matrix(spark, sf):
    return findings.group_by_severity(finding_rows(spark, sf))


@query(f"""WITH {FINDINGS_SQL}, s AS (SELECT * FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) v(severity)) SELECT s.severity, count(*) FILTER (WHERE checkbox = '[ ]') AS open, count(*) FILTER (WHERE checkbox = '[/]') AS deferred,
count(*) FILTER (WHERE checkbox = '[x]') AS resolved, count(*) FILTER (WHERE checkbox = '[-]') AS unreproducible FROM s LEFT JOIN f ON s.severity = f.severity GROUP BY 1""")
def findings_stats(spark, sf):
    return findings.severity_by_state(finding_rows(spark, sf))


@query("""WITH e AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS s FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 3600 THEN 0 ELSE 1 END AS new FROM e),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS cluster FROM g) SELECT user_id, cluster::BIGINT AS cluster, count(*) AS n, min(event_id) AS first FROM c GROUP BY 1, 2""")
def findings_cluster(spark, sf):
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz '1970-01-01'"), F.col("ts").cast("timestamp_ntz"))
    e = t(spark, sf, "events").select("user_id", "event_id", F.rint(micros / 1e6).cast("long").alias("s"))  # whole seconds as the SQL rounds them
    return findings.clustered(e, 3600, "user_id", "s").groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query(f"""WITH {FINDINGS_SQL}, g AS (SELECT *, 'r' || (ord % 3) AS reviewer, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS rk, CASE WHEN line - lag(line) OVER (PARTITION BY file ORDER BY line, ord) <= 0 THEN 0 ELSE 1 END AS new FROM f),
c AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY line, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cl FROM g)
SELECT file, min(line) AS line, count(*) AS merged, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(rk)] AS severity, max(rk) <> min(rk) AS needs_review, max(est_minutes) AS est_minutes,
CASE WHEN count(DISTINCT reviewer) FILTER (WHERE reviewer <> 'r0') >= 2 THEN 'HIGH' WHEN count(DISTINCT reviewer) FILTER (WHERE reviewer <> 'r0') = 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM c GROUP BY file, cl""")
def findings_dedupe(spark, sf):
    rows = finding_rows(spark, sf).withColumns({"reviewer": F.concat(F.lit("r"), (F.col("ord") % 3).cast("string")), "problem": F.lit("p"), "fix": F.lit("x")})
    return findings.dedupe(rows, 0, ["r0"]).select("file", "line", "merged", "severity", "needs_review", "est_minutes", "confidence")


@query("""WITH n AS (SELECT o_orderkey AS id, o_totalprice AS a, o_custkey::DOUBLE AS b, count(*) OVER () AS n FROM orders),
s AS (SELECT *, (rank() OVER (ORDER BY a) - 1 + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / (n - 1) AS an, (rank() OVER (ORDER BY b) - 1 + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / (n - 1) AS bn FROM n),
m AS (SELECT *, (an * 1.0 + bn * 0.15) / 1.15 AS x FROM s) SELECT id, round(x, 6) AS suspicion, row_number() OVER (ORDER BY round(x, 12) DESC, id) <= ceil(n * 20 / 100) AS flagged FROM m""")
def coherence_flags(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    return scoring.coherence_flags(o, {"a": 1.0, "b": 0.15}).select("id", r("suspicion"), "flagged")


# --- texts --------------------------------------------------------------------------------------------------------------


def _extract(kind: str, column: str, table: str, key: str):
    def run(spark, sf):
        return t(spark, sf, table).select(key, F.explode(text.extract(F.col(column), kind, unique=True)).alias("found"))

    return run


for _kind, _column, _table, _key in (("urls", "text", "documents", "doc_id"), ("emails", "text", "documents", "doc_id"), ("ips", "text", "documents", "doc_id"), ("paths", "url", "pages", "page_id")):
    _name, _pattern = f"extract_{_kind}", text.PATTERNS[_kind].replace("'", "''")
    QUERIES[_name] = _extract(_kind, _column, _table, _key)
    SQL[_name] = f"SELECT DISTINCT {_key}, unnest(regexp_extract_all({_column}, '{_pattern}')) AS found FROM {_table}"


def numbered(spark, sf):
    return texts.lines(t(spark, sf, "documents"), "doc_id")


LINES_SQL = "l AS (SELECT doc_id, unnest(range(1, len(x) + 1))::INT AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '(?i)licen[cs]ed? under')")
def grep_lines(spark, sf):
    return files.grep(numbered(spark, sf), "licen[cs]ed? under", ignore_case=True, doc="doc_id").select("doc_id", "line_no")


@query(f"WITH {LINES_SQL} SELECT DISTINCT doc_id FROM l WHERE regexp_matches(line, '[0-9]{{4}}')")
def grep_files(spark, sf):
    return files.grep(numbered(spark, sf), "[0-9]{4}", files_only=True, doc="doc_id")


@query(f"""WITH {LINES_SQL}, h AS (SELECT k AS keyword, doc_id, line_no FROM l, (VALUES ('License'), ('token'), ('Erth')) v(k) WHERE contains(line, k)), x AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY doc_id, line_no) AS rn, count(*) OVER (PARTITION BY keyword) AS total FROM h)
SELECT keyword, doc_id, line_no, total FROM x WHERE rn <= 25""")
def multigrep(spark, sf):
    return files.multigrep(numbered(spark, sf), ["License", "token", "Erth"], 25, "doc_id").select("keyword", "doc_id", "line_no", "total")


@query(f"WITH {LINES_SQL} SELECT DISTINCT line FROM l WHERE trim(line) <> ''")
def sort_unique(spark, sf):
    return numbered(spark, sf).where(F.trim("line") != "").select("line").distinct().orderBy("line")


@query(f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n FROM l WHERE NOT regexp_matches(line, '^[A-Z]') GROUP BY 1")
def filter_invert(spark, sf):
    return files.grep(numbered(spark, sf), "^[A-Z]", invert=True, doc="doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no FROM l WHERE EXISTS (SELECT 1 FROM l m WHERE m.doc_id = l.doc_id AND m.line_no BETWEEN l.line_no - 1 AND l.line_no + 1 AND contains(m.line, 'License'))")
def extract_context(spark, sf):
    return texts.extract_lines(numbered(spark, sf), pattern="License", context=1, doc="doc_id").select("doc_id", "line_no")


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines, len(regexp_extract_all(text, 'the'))::INT AS changes FROM documents")
def count_lines(spark, sf):
    d = files.replace_text(t(spark, sf, "documents"), "the", "THE")
    return d.select("doc_id", F.size(F.split("text", "\n")).alias("lines"), "changes")


def checklist(spark, sf):
    box = F.when(F.col("o_orderstatus") == "F", "x").otherwise(" ")
    return t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- ["), box, F.lit("] order "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")))), "\n").alias("text"))


@query("SELECT o_custkey AS doc, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS rate FROM orders GROUP BY 1")
def md_tasks(spark, sf):
    tasks = texts.parse_checklist(texts.lines(checklist(spark, sf)))
    return tasks.groupBy("doc").agg(F.count(F.lit(1)).alias("total"), F.count_if("checked").alias("done")).withColumn("rate", F.round(F.col("done") * 100.0 / F.col("total"), 4))


@query("SELECT o_custkey AS doc, count(*) FILTER (WHERE o_orderstatus = 'F')::INT AS checked, count(*) FILTER (WHERE o_orderstatus <> 'F')::INT AS unchecked FROM orders GROUP BY 1")
def count_checkboxes(spark, sf):
    counts = text.checkbox_counts(F.col("text"))
    return checklist(spark, sf).select("doc", counts["checked"].alias("checked"), counts["unchecked"].alias("unchecked"))


@query("""SELECT p_partkey AS id, upper(p_name) AS upper, lower(p_name) AS lower, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name, '[-_\\s]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), '') AS pascal,
lower(regexp_replace(regexp_replace(regexp_replace(p_name, '(.)([A-Z][a-z]+)', '\\1-\\2', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[_\\s]+', '-', 'g')) AS kebab FROM part""")
def case_transforms(spark, sf):
    n = F.col("p_name")
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), *[text.change_case(n, k).alias(a) for k, a in (("uppercase", "upper"), ("lowercase", "lower"), ("PascalCase", "pascal"), ("kebab-case", "kebab"))])


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hashes(spark, sf):
    raw = F.col("text").cast("binary")
    return t(spark, sf, "documents").select("doc_id", *[text.digest(raw, k).alias(k) for k in ("md5", "sha1", "sha256")])


@query("SELECT p_partkey AS id, base64(p_name::BLOB) AS b64, lower(hex(p_name)) AS hx, url_encode(p_name) AS url, p_name AS back FROM part")
def encodings(spark, sf):
    n = F.col("p_name")
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.encode(n, "base64").alias("b64"), text.encode(n, "hex").alias("hx"), text.encode(n, "url").alias("url"), text.decode(text.encode(n, "base32"), "base32").alias("back"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_query(spark, sf):
    return t(spark, sf, "events").select("event_id", text.json_query(F.col("props"), "k").alias("k"))


@query("SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events")
def json_merge(spark, sf):
    e = t(spark, sf, "events").select("event_id", text.json_merge(F.lit('{"kind": "none", "k": "0"}'), F.col("props"), F.to_json(F.struct(F.col("event_type").alias("kind")))).alias("j"))
    return e.select("event_id", text.json_query(F.col("j"), "kind").alias("kind"), text.json_query(F.col("j"), "k").alias("k"))


@query("SELECT p_partkey AS id, CASE WHEN p_size * 40960 + 100 >= 1048576 THEN printf('%.1f MB', (p_size * 40960 + 100) / 1048576) ELSE printf('%.1f KB', (p_size * 40960 + 100) / 1024) END AS size, printf('%02d:%02d:%02d', (p_size * 997) // 3600, (p_size * 997) // 60 % 60, p_size * 997 % 60) AS took FROM part")
def formats(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.format_size(F.col("p_size") * 40960 + 100).alias("size"), text.format_duration(F.col("p_size") * 997, "hms").alias("took"))


@query("SELECT p_partkey AS id, round(p_retailprice * 2 + pow(p_size, 2) % 7 - abs(3 - p_size), 6) AS value FROM part")
def arithmetic(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(text.arithmetic("p_retailprice * 2 + p_size ** 2 % 7 - abs(3 - p_size)"), 6).alias("value"))


@query("""SELECT doc_id, CASE WHEN len(x) > 150 THEN x[1:150] || '...' ELSE x END AS preview FROM (SELECT doc_id, regexp_replace(text, '[\\n\\t]', ' ', 'g') AS x FROM documents)""")
def previews(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.preview(F.lit(""), F.col("text")).alias("preview"))


# --- reports ------------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) AS covered, round(100.0 * count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) / count(*), 6) AS percent FROM part")
def coverage(spark, sf):
    return reports.coverage(t(spark, sf, "part").select(F.col("p_partkey").alias("id")), t(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("id"))).withColumn("percent", F.round("percent", 6))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def uncovered(spark, sf):
    return reports.uncovered(t(spark, sf, "part").select(F.col("p_partkey").alias("id")), t(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id")))


@query("""WITH s AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS file, CASE WHEN l_returnflag = 'R' THEN 'complete' WHEN l_returnflag = 'A' THEN 'partial' END AS status FROM lineitem WHERE l_quantity > 45),
f AS (SELECT id, min_by(status, file) AS status FROM s WHERE status IS NOT NULL GROUP BY id), a AS (SELECT p_partkey, status FROM part LEFT JOIN f ON p_partkey = id WHERE p_partkey % 2 = 0)
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'complete') AS met, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status IS NULL) AS unmet,
(SELECT count(DISTINCT id) FROM s WHERE id % 2 = 1) AS creep, round((count(*) FILTER (WHERE status = 'complete') + 0.5 * count(*) FILTER (WHERE status = 'partial')) * 100.0 / count(*), 6) AS score FROM a""")
def alignment(spark, sf):
    stories = t(spark, sf, "lineitem").where("l_quantity > 45").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file"), F.col("l_partkey").alias("id"), F.when(F.col("l_returnflag") == "R", "complete").when(F.col("l_returnflag") == "A", "partial").alias("status"))
    return reports.alignment(t(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id")), stories).withColumn("score", F.round("score", 6))


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS id, l_returnflag AS source FROM lineitem WHERE l_quantity > 49), c AS (SELECT id, string_agg(source, ',' ORDER BY source) AS by_ FROM m GROUP BY id)
SELECT s_suppkey AS id, coalesce(by_, '') AS covered_by FROM supplier LEFT JOIN c ON s_suppkey = id""")
def risk_coverage(spark, sf):
    mentions = t(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("source"))
    return reports.risk_coverage(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), mentions).select("id", F.array_join("covered_by", ",").alias("covered_by"))


@query("""WITH f AS (SELECT event_id AS ord, 'f' || user_id AS stem, CASE WHEN event_id % 3 = 0 THEN 't' ELSE 'c' END AS kind FROM events), x AS (SELECT stem, min(ord) AS first_test FROM f WHERE kind = 't' GROUP BY stem),
c AS (SELECT ord, CASE WHEN kind = 't' THEN 'test_only' WHEN first_test < ord THEN 'test_first' WHEN first_test > ord THEN 'test_after' ELSE 'no_test' END AS class FROM f LEFT JOIN x USING (stem)) SELECT class, count(*) AS n, min(ord) AS first FROM c GROUP BY 1""")
def tdd_order(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_id").alias("ord"), F.array(F.concat(F.lit("f"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "_test.go").otherwise(".go"))).alias("files"))
    return reports.commit_classes(e).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


PATHS_SQL = "p AS (SELECT page_id, ['src/a.go', 'src/a_test.go', 'dist/x.js', 'README.md', 'conf/app.yaml', 'secrets.json', 'bin/tool', 'web/x.test.ts'][(page_id % 8 + 1)::INT] AS path FROM pages)"


def paths(spark, sf):
    names = F.array(*[F.lit(x) for x in ("src/a.go", "src/a_test.go", "dist/x.js", "README.md", "conf/app.yaml", "secrets.json", "bin/tool", "web/x.test.ts")])
    return t(spark, sf, "pages").select("page_id", F.element_at(names, (F.col("page_id") % 8 + 1).cast("int")).alias("path"))


@query(f"""WITH {PATHS_SQL}, c AS (SELECT CASE WHEN path IN ('src/a_test.go', 'web/x.test.ts') THEN 'test' WHEN path = 'dist/x.js' THEN 'generated' WHEN path = 'README.md' THEN 'docs' WHEN path IN ('conf/app.yaml', 'secrets.json') THEN 'config' WHEN path = 'src/a.go' THEN 'source' ELSE 'other' END AS category, path FROM p)
SELECT category, count(*) AS n, count(*) FILTER (WHERE path = 'secrets.json') AS sensitive FROM c GROUP BY 1""")
def categorise_paths(spark, sf):
    return reports.categorise(paths(spark, sf))


@query("""SELECT p_partkey AS id, CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN 'exact' WHEN regexp_matches(p_type, '^[^/]*STEEL$') OR regexp_matches(p_type, '^[^/]*steel$') THEN 'glob' WHEN contains(lower(p_type), 'e') THEN 'word' ELSE 'unassigned' END AS tier FROM part""")
def tiering(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    least = p.agg(F.min("name")).first()[0]
    return reports.classify_tiers(p, {least: "exact"}, [("*STEEL", "glob"), ("*steel", "glob")], [("E", "word")]).select("id", "tier")


@query("""SELECT max_by(name, (major, minor)) AS name, max(major) AS major, max_by(minor, (major, minor)) AS minor, max(major) || '.' || (max_by(minor, (major, minor)) + 1) AS next FROM (SELECT (p_size || '.' || (p_partkey % 13) || '_' || lpad(p_partkey::VARCHAR, 6, '0')) AS name, p_size::BIGINT AS major, (p_partkey % 13)::BIGINT AS minor FROM part)
WHERE name = (SELECT max_by(x.name, (x.major, x.minor, x.name)) FROM (SELECT (p_size || '.' || (p_partkey % 13) || '_' || lpad(p_partkey::VARCHAR, 6, '0')) AS name, p_size AS major, p_partkey % 13 AS minor FROM part) x)""")
def highest_version(spark, sf):
    names = t(spark, sf, "part").select(F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string"), F.lit("_"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("name"))
    return reports.highest_version(names)


def deps(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("dep"))


@query("SELECT DISTINCT a.l_orderkey AS a, b.l_orderkey AS b FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey")
def conflict_graph(spark, sf):
    return reports.conflict_edges(deps(spark, sf))


@query("SELECT l_partkey AS dep, count(DISTINCT l_orderkey) AS items, count(DISTINCT l_orderkey) * (count(DISTINCT l_orderkey) - 1) // 2 AS pairs, min(l_orderkey) AS first FROM lineitem GROUP BY 1")
def conflict_groups(spark, sf):
    return reports.conflict_groups(deps(spark, sf))


@query()
def colouring(spark, sf):
    return reports.frontier_colours(deps(spark, sf))


def refs(spark, sf):
    return t(spark, sf, "supplier").select(F.col("s_suppkey").alias("chunk_id"), F.when(F.col("s_suppkey") % 2 == 0, "calls").otherwise("imports").alias("ref_type"), (F.col("s_nationkey") % 30).cast("string").alias("ref_name"))


def named_chunks(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("name"))


@query("SELECT s_suppkey AS chunk_id, (s_nationkey % 30)::VARCHAR AS ref_name, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = s_nationkey % 30) AS ref_target_id FROM supplier")
def ref_resolution(spark, sf):
    return reports.resolve_refs(refs(spark, sf), named_chunks(spark, sf)).select("chunk_id", "ref_name", "ref_target_id")


@query("SELECT s_suppkey AS chunk_id FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer))")
def callers(spark, sf):
    chunks = named_chunks(spark, sf)
    return reports.callers(reports.resolve_refs(refs(spark, sf), chunks), chunks.agg(F.min("id")).first()[0]).select("chunk_id")


def file_table(spark, sf):
    return t(spark, sf, "documents").select(F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("."), F.col("lang")).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id"))


@query("SELECT doc_id, n_chars AS size FROM documents ORDER BY n_chars DESC, source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.' || lang LIMIT 20 OFFSET 40")
def page_listing(spark, sf):
    return files.listing(file_table(spark, sf), "size", True, 3, 20).select("doc_id", "size")


@query("SELECT lang AS ext, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1")
def ext_stats(spark, sf):
    return files.extension_stats(file_table(spark, sf))


@query("SELECT doc_id, n_chars AS size FROM documents WHERE n_chars >= 5000 ORDER BY n_chars DESC, source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.' || lang LIMIT 100")
def large_items(spark, sf):
    return files.large_files(file_table(spark, sf), 5000).select("doc_id", "size")


@query("SELECT sum(n_chars)::BIGINT AS bytes, count(*) AS files, count(DISTINCT source) AS dirs FROM documents")
def disk_usage(spark, sf):
    return files.disk_usage(file_table(spark, sf))


@query("SELECT source AS path, 1 AS depth, true AS is_dir, sum(n_chars)::BIGINT AS size FROM documents GROUP BY source")
def dir_tree(spark, sf):
    return files.tree(file_table(spark, sf), 1).select("path", "depth", "is_dir", "size")


@query("SELECT doc_id FROM (SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 20000 * 4")
def budgeted_scan(spark, sf):
    return files.within_budget(t(spark, sf, "documents"), 20000, "doc_id").select("doc_id")


@query()
def near_overlap_dedup(spark, sf):
    li = t(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("file_path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 500).cast("int").alias("start_line"), (F.col("l_partkey") % 500 + F.col("l_quantity").cast("int")).cast("int").alias("end_line"), F.col("l_extendedprice").alias("score"))
    return reports.suppress_overlaps(li, 0.5)


@query()
def html_chunks(spark, sf):
    return chunkers.chunk_files(t(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text")))


@query("""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS words FROM pages),
l AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') || unnest(hrefs) AS url, unnest(words) AS text, unnest(range(len(hrefs))) AS position FROM a)
SELECT page_id, url, min_by(text, position) AS text, 'li' AS context, 35::INT AS score, min(position)::INT AS position FROM l GROUP BY page_id, url""")
def html_links(spark, sf):
    return chunkers.extract_links(t(spark, sf, "pages"))


#: Lines packed in order until the next would pass the size, by a step a line.
CHUNKS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
f AS (SELECT doc_id, 1 AS i, 1 AS start, length(ls[1]) + 1 AS total FROM d
 UNION ALL SELECT f.doc_id, i + 1, CASE WHEN total + length(ls[i + 1]) + 1 > {chunkers.SIZES["generic"]} THEN i + 1 ELSE start END, CASE WHEN total + length(ls[i + 1]) + 1 > {chunkers.SIZES["generic"]} THEN 0 ELSE total END + length(ls[i + 1]) + 1 FROM f JOIN d USING (doc_id) WHERE i < len(ls)),
c AS (SELECT doc_id, start, max(i) AS stop FROM f GROUP BY doc_id, start)
SELECT doc_id || '.txt' AS path, 'file' AS type, 'lines ' || start || '-' || stop AS name, array_to_string(ls[start:stop], chr(10)) AS content, start::INT AS start_line, stop::INT AS end_line, 'text' AS language
FROM c JOIN d USING (doc_id) WHERE stop < len(ls) OR trim(array_to_string(ls[start:stop], ''), ' ' || chr(9) || chr(13)) <> ''"""


@query(CHUNKS_SQL)
def generic_chunks(spark, sf):
    return chunkers.chunk_files(t(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS context FROM documents")
def overlap_context(spark, sf):
    return t(spark, sf, "documents").select("doc_id", texts.line_range(F.col("text"), 2, 3).alias("context"))


@query("SELECT conv_id, max(turn) AS turns, max_by(role, turn) AS last_role FROM conversations GROUP BY 1")
def last_turns(spark, sf):
    c = t(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.max("turn").alias("turns"), F.max_by("role", "turn").alias("last_role"))


from loomstead.plans import more  # noqa: E402, F401  registers the rest
from loomstead.plans import stateful  # noqa: E402, F401
