"""License texts that are wrapped over several lines."""

import textwrap

from loomstead.llm.license_scan import TEMPLATES, scan


def test_wrapped_templates_are_found(spark):
    rows = [(i, "Some words first.\n\n/*\n" + textwrap.indent(textwrap.fill(t, 40), " * ") + "\n */\n\nand the end", k) for i, (k, t) in enumerate(TEMPLATES.items())]
    apart = "released work\n\nunder a name\n\nthe mit\n\nlicense"
    far = "\n".join(f"{w} " + " ".join(f"x{i}" for i in range(20)) for w in "released under the mit license".split())
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100, apart), (101, far)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan(docs).collect()}
    for i, _, label in rows:
        assert label in got[i].labels.split(",") and got[i].score == 1.0
    assert got[100].labels == got[101].labels == "" and got[100].score == 0.0
