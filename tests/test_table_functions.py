"""Table functions in SQL: nulls, names that clash, partitions, and what they refuse."""

import pytest

from loomstead.functions import table_functions


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    rows = [("a.md", "# one\nx\n\n# two\ny", 1, "n1"), ("b.txt", "plain", 2, None), (None, "no path", 3, "n3"), ("c.md", None, 4, "n4"), ("d.md", "", 5, "n5"), ("a.md", "# one\nx\n\n# two\ny", 1, "n1")]
    spark.createDataFrame(rows, "path string, text string, id int, name string").createOrReplaceTempView("files_of_a_test")
    return spark.sql


def test_chunks_of_a_table_keep_its_columns(sql):
    got = sql("SELECT * FROM file_chunks(TABLE(files_of_a_test))")
    assert got.columns == ["path", "id", "name", "type", "chunk_name", "content", "start_line", "end_line", "language"]
    rows = [tuple(r) for r in got.select("path", "id", "name", "chunk_name").collect()]
    assert sorted(rows, key=str) == sorted([("a.md", 1, "n1", "one"), ("a.md", 1, "n1", "two")] * 2 + [("b.txt", 2, None, "lines 1-1"), (None, 3, "n3", "lines 1-1")], key=str)
    by = sql("SELECT count(*) AS n FROM file_chunks(TABLE(SELECT id AS path, text AS body FROM (SELECT string(id) || '.md' AS id, text FROM files_of_a_test)) PARTITION BY path, text => 'body')")
    assert by.first().n == 6


def test_what_is_refused(sql):
    for call in ("file_chunks(TABLE(files_of_a_test), path => 'nowhere')", "file_chunks('x')"):
        with pytest.raises(Exception, match="no column nowhere|takes TABLE"):
            sql(f"SELECT * FROM {call}").collect()


def test_lateral_rows(sql):
    assert [tuple(r) for r in sql("SELECT id, start_line, end_line FROM files_of_a_test, LATERAL text_chunks(text, 6) WHERE id = 1 ORDER BY ALL").collect()] == [(1, 1, 1), (1, 1, 1), (1, 2, 3), (1, 2, 3), (1, 4, 4), (1, 4, 4), (1, 5, 5), (1, 5, 5)]
    assert sql("SELECT * FROM files_of_a_test, LATERAL text_chunks(text) WHERE id > 3").count() == 0
    got = sql("""SELECT link, words FROM LATERAL page_links('<p><a href="/x">to <b>x</b></a><a href="#y">y</a><a href="/x">again</a>', 'http://h.org/a')""").collect()
    assert [tuple(r) for r in got] == [("http://h.org/x", "to x")] and sql("SELECT * FROM LATERAL page_links(null, null)").count() == 0
