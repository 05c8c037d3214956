"""Queries against their SQL on small tables that hold what larger ones do."""

import duckdb
import pytest

from loomstead.operators import scoring
from loomstead.plans.catalogue import QUERIES, SQL


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(SQL[name]).fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, str(folder)).select(*con.sql(SQL[name]).columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_findings_cluster_rounds_seconds_as_its_sql(spark, tmp_path):
    times = ["00:00:00.400000", "01:00:00.600000", "02:00:00.500000", "03:00:00.500000", "04:00:01.500000", "05:00:02.499999"]
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS event_id, TIMESTAMP '2024-01-01 {x}' AS ts, {i // 4}::BIGINT AS user_id" for i, x in enumerate(times))
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = same_as_sql(spark, tmp_path, "findings_cluster")
    assert sorted(got) == [(0, 0, 1, 0), (0, 1, 3, 1), (1, 0, 2, 4)]


def test_memory_hybrid_equals_its_sql_beyond_as_of(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT i * 300 AS doc_id, 'the tale of ' || repeat('word ', i::INT) AS text, 'src' AS source, 'en' AS lang, 1::BIGINT AS n_chars FROM range(12) r(i)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (SELECT i * 300 AS vec_id, [cos(i), sin(i)]::FLOAT[] AS embedding, 1 AS label FROM range(12) r(i)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    same_as_sql(spark, tmp_path, "memory_hybrid")


def test_decay_of_the_future_stands_still_unless_asked(spark):
    from pyspark.sql import functions as F

    at, as_of = F.to_timestamp(F.lit("2024-06-29 00:00:00")), F.to_timestamp(F.lit("2024-03-31 00:00:00"))
    row = spark.range(1).select(scoring.temporal_decay(F.lit(1.0), at, as_of).alias("a"), scoring.temporal_decay(F.lit(1.0), at, as_of, negative=True).alias("b")).first()
    assert row.a == 1.0 and row.b == pytest.approx(2.0)


def test_yaml_edits_read_a_text_once_an_edit_and_equal_texts_once(monkeypatch):
    import pandas as pd
    from loomstead.functions import editing, yaml_splice

    read, parsed = [], yaml_splice.parsed
    monkeypatch.setattr(yaml_splice, "parsed", lambda text: read.append(text) or parsed(text))
    edits = [("set", "size", "fresh"), ("push", "tags", "end"), ("delete", "old", None)]
    done = editing._run_yaml(pd.Series(["size: 3  # kept\ntags: [a]\nold: 1\n"] * 50), edits)
    assert set(done["text"]) == {"size: fresh  # kept\ntags: [a, end]\n"} and len(read) == 4


@pytest.mark.parametrize("name", ["yaml_edits", "yaml_comments"])
def test_yaml_queries_use_more_than_one_task(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_colouring_meets_blocks_in_more_than_one_task(spark, monkeypatch):
    from loomstead.operators import reports
    from loomstead.plans import staging

    tasks, write = [], staging.staged
    monkeypatch.setattr(staging, "staged", lambda df, name: (tasks.append(df.rdd.getNumPartitions()) if name == "tokens" else None, write(df, name))[1])
    deps = spark.createDataFrame([(i, i % 40) for i in range(400)], "item long, dep long")
    got = {r.item: r.colour for r in reports.frontier_colours(deps, block=100, run=3).collect()}
    assert got == {i: i // 40 for i in range(400)}
    assert max(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_similar_questions_makes_its_pairs_in_all_tasks(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT i AS p_partkey, ['able baker', 'baker delta', 'echo golf'][1 + i % 3] AS p_name FROM range(600) r(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    tasks = QUERIES["similar_questions"](spark, str(tmp_path)).rdd.glom().map(len).collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(n > 0 for n in tasks) > 1
    same_as_sql(spark, tmp_path, "similar_questions")
