"""Near copies where ids are null or repeated."""

import corpus_pipeline


def test_one_document_stays_of_each_group_without_ids(spark):
    texts = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcd"}
    rows = [(None, texts["a"]), (None, texts["a"]), (None, texts["b"]), (7, texts["c"]), (7, texts["d"]), (8, texts["d"]), (None, None), (9, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    want = [(None, texts["a"]), (None, texts["b"]), (7, texts["c"]), (7, texts["d"]), (None, None), (9, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
