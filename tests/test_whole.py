"""Queries and operators over their whole tables, against brute force."""

import random

from loomstead.operators import knowledge, reports
from loomstead.plans import catalogue


def test_similar_questions_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["able", "baker", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "tea"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 7)))) for i in range(150)] + [(1000 + i, "delta echo") for i in range(9)]
    words = {i: [w for w in q.split() if len(w) > 3] for i, q in rows}
    questions = spark.createDataFrame(rows, "id long, question string")
    for share in (0.3, 0.5, 0.8):
        want = {}
        for a in words:
            for b in words:
                n = sum(w in words[b] for w in words[a])
                if a < b and n and n >= share * min(len(words[a]), len(words[b])):
                    want[a, b] = n
        got = knowledge.similar_questions(questions, share, 4).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.common for r in got} == want


def test_similar_questions_runs_on_all_parts(spark, tmp_path):
    rows = [(i, f"word{i // 2}x") for i in range(290, 320)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.a, r.b) for r in catalogue.similar_questions(spark, str(tmp_path)).collect()}
    assert got == {(i, i + 1) for i in range(290, 320, 2)}


def test_conflict_graph_runs_on_all_orders(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(395, 460), rng.randint(1, 40)) for _ in range(200)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").coalesce(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = {(a, b) for a, x in rows for b, y in rows if x == y and a < b}
    got = catalogue.conflict_graph(spark, str(tmp_path)).collect()
    assert len(got) == len(pairs) and {(r.a, r.b) for r in got} == pairs
    want = {}
    for item in sorted({a for a, _ in rows}):
        taken = {want[a] for a, b in pairs if b == item}
        want[item] = next(c for c in range(len(rows)) if c not in taken)
    got = catalogue.colouring(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.item: r.colour for r in got} == want
    d = spark.createDataFrame([*rows, (None, 1), (500, None)], "item long, dep long")
    got = reports.frontier_colours(d, 60).collect()
    assert len(got) == len(want) + 2 and {r.item: r.colour for r in got} == {**want, None: 0, 500: 0}


def test_overlaps_run_on_all_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"f{rng.randint(0, 2)}", i, s := rng.randint(0, 300), s + rng.randint(-1, 12), float(rng.randint(0, 40))) for i in range(600)]
    for threshold in (0.3, 0.5, 1.0):
        want = set()
        for f in {r[0] for r in rows}:
            kept = []
            for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[4], r[1])):
                n = r[3] - r[2] + 1
                if not n or not any(max(0, min(r[3], k[3]) - max(r[2], k[2]) + 1) / n >= threshold for k in kept):
                    kept.append(r)
            want |= set(kept)
        got = reports.suppress_overlaps(spark.createDataFrame(rows, "file_path string, id long, start_line int, end_line int, score double"), threshold).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    lines = [(4050, 1, 7, 3.0, 9.0), (4050, 2, 507, 3.0, 8.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.id for r in catalogue.near_overlap_dedup(spark, str(tmp_path)).collect()] == [40501]


def test_colours_with_nulls(spark):
    nodes = spark.createDataFrame([(1,), (2,), (None,), (2,)], "item long")
    edges = spark.createDataFrame([(1, 2), (None, 2), (1, None)], "a long, b long")
    assert {r.item: r.colour for r in reports.greedy_colours(nodes, edges).collect()} == {1: 0, 2: 1}
    assert reports.conflict_edges(spark.createDataFrame([(1, 5), (2, 5), (None, 5), (3, None), (4, None), (1, 5)], "item long, dep long")).count() == 1
