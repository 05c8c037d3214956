"""Stores that are changed in place, tracking with state, streamed re-indexing, side indexes, vector indexes and colouring."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.operators import lexical, reports, vector_index, vectors
from loomstead.operators.bucket_store import BucketStore
from loomstead.operators.side_index import SideIndex
from loomstead.streaming import reindex, retrieval, tracking

KIND = "id long, name string, created_at string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- the store ------------------------------------------------------------------------------------------------------------


def test_changes_return_counts_and_fail_as_a_whole(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, KIND)
    store = BucketStore(spark, f"{tmp_path}/s", KIND, buckets=4)
    assert store.rows().count() == 0 and store.insert(make()) == 0
    assert store.insert(make(*[(i, f"n{i}", "old") for i in range(20)])) == 20
    with pytest.raises(ValueError, match="id 7 is there already"):
        store.insert(make((100, "x", "new"), (7, "x", "new")))
    for bad in (make((30, "a", "b"), (30, "a", "b")), make((None, "a", "b"))):
        with pytest.raises(ValueError, match="null or given more than once"):
            store.upsert(bad)
    assert store.rows().count() == 20
    assert store.upsert(make((7, "seven", "new"), (50, None, None))) == {"inserted": 1, "updated": 1}
    assert rows_of(store.rows().where("id in (7, 50)")) == [(50, None, None), (7, "seven", "old")]
    with pytest.raises(LookupError, match="no row with id 99"):
        store.update(spark.createDataFrame([(1, "one"), (99, "none")], "id long, name string"))
    assert store.update(spark.createDataFrame([(1, "one", 5)], "id long, name string, other int")) == 1
    assert rows_of(store.rows(make((1, None, None)))) == [(1, "one", "old")]
    with pytest.raises(LookupError, match="no row with id 99"):
        store.delete(spark.createDataFrame([(1,), (99,)], "id long"))
    assert store.delete(spark.createDataFrame([(1,), (1,), (2,)], "id long")) == 2
    assert store.delete_where("created_at", "old") == 18 and store.delete_where("name", "nobody") == 0
    assert rows_of(store.rows()) == [(50, None, None)] and store.clear() == 1 and store.rows().count() == 0


def test_a_change_reads_and_writes_its_buckets_alone(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s", KIND, buckets=8)
    store.insert(spark.range(200).select("id", F.lit("n").alias("name"), F.lit("c").alias("created_at")))
    stamps = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("bucket=*/*.parquet")}
    before, one = stamps(), spark.createDataFrame([(3, "three", "x")], KIND)
    bucket = one.select(store.bucket_of(F.col("id"))).first()[0]
    store.upsert(one)
    after = stamps()
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if p.parent.name == f"bucket={bucket}"}
    plan = store.rows(one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"bucket#" in plan.split("PartitionFilters")[1][:80]


def test_replacement_takes_all_rows_of_a_key(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s", KIND, key="name", buckets=3)
    make = lambda *rows: spark.createDataFrame(rows, KIND)
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    assert store.replace(keys("a", "b"), make((1, "a", "x"), (2, "a", "x"), (3, "b", "x"))) == {"deleted": 0, "inserted": 3}
    assert store.replace(keys("a", "c"), make((4, "a", "y"))) == {"deleted": 2, "inserted": 1}
    assert rows_of(store.rows()) == [(3, "b", "x"), (4, "a", "y")]
    with pytest.raises(ValueError, match="not among the keys"):
        store.replace(keys("a"), make((5, "z", "y")))
    ran = []
    assert store.once("x", lambda: ran.append(1)) and not store.once("x", lambda: ran.append(2)) and ran == [1]


# --- streams --------------------------------------------------------------------------------------------------------------


def test_tracking_counts_a_row_once_and_goes_on_after_a_stop(spark, tmp_path):
    log = [(1, "a", "q", 0.5, "2024-01-01 00:00:01"), (2, "a", "q", 0.7, "2024-01-01 00:00:03"), (3, "b", "q", None, None), (2, "a", "q", 0.7, "2024-01-01 00:00:03"), (None, "b", "q", 1.0, "2024-01-01 00:00:02"), (4, None, "q", 1.0, None)]
    put = lambda name, rows: spark.createDataFrame(rows, "id long, memory_id string, query string, score double, t string").withColumn("timestamp", F.to_timestamp("t")).drop("t").write.parquet(f"{tmp_path}/log/{name}")
    go = lambda: tracking.run_tracking(retrieval.read_log(spark, f"{tmp_path}/log/*"), f"{tmp_path}/stats", f"{tmp_path}/at")
    put("one", log)
    go()
    seen = lambda: {r.memory_id: (r.n, r.avg_score and round(r.avg_score, 6), r["last"] and r["last"].second) for r in tracking.tracked(spark, f"{tmp_path}/stats").collect()}
    assert seen() == {"a": (2, 0.6, 3), "b": (2, 1.0, 2)}
    put("two", [(1, "a", "q", 9.0, "2024-01-02 00:00:00"), (9, "a", "q", 0.9, "2024-01-01 00:00:02"), (10, "c", "q", 0.0, None)])
    go()
    assert seen() == {"a": (3, 0.7, 3), "b": (2, 1.0, 2), "c": (1, 0.0, None)}
    go()
    assert seen()["a"] == (3, 0.7, 3)


def test_files_are_applied_by_their_last_version(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s", reindex.CHUNKS, key="file_path", buckets=4)
    files = lambda *rows: spark.createDataFrame(rows, "path string, text string, version int")
    assert reindex.apply_files(store, files(("a.md", "# one\nx", 1), ("a.md", "# two\ny\n\n# three\nz", 2), ("b.md", "# b", 1), (None, "# n", 1), ("c.md", None, 1)))["changed"] == 2
    assert {(r.file_path, r.name) for r in store.rows().collect()} == {("a.md", "two"), ("a.md", "three"), ("b.md", "b")}
    assert reindex.apply_files(store, files(("a.md", "# two\ny\n\n# three\nz", 3), ("b.md", None, 2))) == {"deleted": 1, "inserted": 0, "changed": 1}
    assert {r.file_path for r in store.rows().collect()} == {"a.md"}
    assert reindex.apply_files(store, files()) == {"deleted": 0, "inserted": 0, "changed": 0}


# --- indexes --------------------------------------------------------------------------------------------------------------


def test_only_damaged_buckets_are_built_again(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdef") * 3 for _ in range(20))) for i in range(80)] + [(90, None), (91, ""), (None, "null id")], "id long, text string")
    index = SideIndex(spark, f"{tmp_path}/i", buckets=8)
    index.build(docs)
    fresh = rows_of(index.postings())
    assert [tuple(r[:3]) for r in fresh] == rows_of(lexical.build_postings(docs)[0]) and index.repair(docs) == 0
    stamps = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "i" / "postings").glob("bucket=*/*.parquet")}
    lost = next(iter(sorted(stamps())))
    lost.unlink()
    kept = stamps()
    assert index.check(docs).where("state = 'damaged'").count() == 1
    assert index.repair(docs) == 1 and rows_of(index.postings()) == fresh and {p: t for p, t in stamps().items() if p in kept} == kept
    changed = docs.withColumn("text", F.when(F.col("id") == 5, "new words").otherwise(F.col("text"))).where("id is null or id <> 90")
    assert {r.state for r in index.check(changed).collect()} == {"stale", "whole"} and 1 <= index.repair(changed) <= 2
    assert [tuple(r[:3]) for r in rows_of(index.postings())] == rows_of(lexical.build_postings(changed)[0])
    index.repair(docs.limit(0))
    assert index.postings().count() == 0


def test_vectors_are_found_by_lists_and_codes(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    points = np.concatenate([centres[i % 12] + 0.4 * rng.normal(size=16) for i in range(900)]).reshape(900, 16)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(1000, None), (1001, [0.0] * 16), (1002, [1.0, 2.0]), (3, [float(x) for x in points[3]])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    index = vector_index.VectorIndex.build(df, f"{tmp_path}/v")
    assert index.rows().count() == len(rows) and 25 <= len(index.centroids) <= 35
    asked = df.where("id % 50 = 0 and id < 1000").select(F.col("id").alias("q"), F.col("embedding").alias("vector"))
    exact = index.search(asked, 10, probes=len(index.centroids), rerank=0)
    wanted = [(str(r.q), list(r.vector)) for r in asked.collect()]
    plain = vectors.top_k_each(vectors.matrix_scores(df, wanted), ["query"], 10)
    assert sorted((r.q, r["rank"], round(r.score, 5)) for r in exact.collect()) == sorted((int(r["query"]), r["rank"], round(r.score, 5)) for r in plain.collect())
    found = vector_index.recall(index.search(asked, 10, probes=6, rerank=40), exact).first()
    assert found.queries == 18 and found.recall >= 0.9
    plan = index.rows([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters")[1][:60]
    assert index.search(asked.limit(0), 10, 3).count() == 0
    empty = vector_index.VectorIndex.build(df.limit(0), f"{tmp_path}/e")
    assert empty.search(asked, 5, 1).count() == 0


# --- colouring ------------------------------------------------------------------------------------------------------------


def plain_colours(rows):
    deps, used, out = {}, {}, {}
    for item, dep in rows:
        if item is not None:
            deps.setdefault(item, set()).update([dep] if dep is not None else [])
        else:
            out[item] = 0
    for item in sorted(deps):
        out[item] = next(c for c in range(len(deps) + 1) if not any(c in used.get(d, ()) for d in deps[item]))
        for d in deps[item]:
            used.setdefault(d, set()).add(out[item])
    return out


@pytest.mark.parametrize(("block", "run"), [(7, 2), (10_000, 16)])
def test_colours_are_those_of_the_sequential_rule(spark, block, run):
    """A dependency of a third of all items, items of many dependencies, and items of none."""
    rng = random.Random(block)
    rows = [(f"i{rng.randrange(40):03}", rng.randrange(15)) for _ in range(110)] + [(f"i{i:03}", 99) for i in range(0, 40, 3)] + [("z", None), (None, 3), ("i003", None)]
    got = {r.item: r.colour for r in reports.frontier_colours(spark.createDataFrame(rows, "item string, dep long"), block, run).collect()}
    assert got == plain_colours(rows)


def test_nothing_to_colour(spark):
    assert reports.frontier_colours(spark.createDataFrame([], "item long, dep long")).count() == 0
