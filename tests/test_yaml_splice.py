"""YAML edits as splices: meaning against plain edits of the read document, and bytes that stay."""

import copy
import random

import pytest
import yaml
from pyspark.sql import functions as F

from loomstead.functions import editing, yaml_splice

TEXT = """# settings of a tool
name: "a tool"   # quoted
limits:          # how much
  size: 0x10     # in hex
  list: [1, 2,  3]   # flow
  # about depth
  depth:  4
paths:
  - src/a   # first

  - 'src/b'
  - deep:
      x: 1
      y: |
        kept
          as is
empty:
last: {a: b,  c: d} # end
"""


def spliced(text, *edits):
    for op, path, value in edits:
        text = yaml_splice.splice(text, op, editing.path_parts(path), value)
    return text


@pytest.mark.parametrize(
    ("edit", "old", "new"),
    [
        (("set", "limits.size", 32), "0x10 ", "32 "), (("set", "name", "x: y"), '"a tool"', "'x: y'"), (("set", "empty", 5), "empty:", "empty: 5"), (("set", "paths[1]", "c"), "'src/b'", "c"),
        (("set", "limits.new", "v"), "  depth:  4\n", "  depth:  4\n  new: v\n"), (("set", "last.c", 7), "c: d", "c: 7"), (("set", "last.e", "f"), "c: d}", "c: d, e: f}"), (("push", "limits.list", 4), "2,  3]", "2,  3, 4]"),
        (("push", "paths", "z"), "          as is\n", "          as is\n  - z\n"), (("delete", "limits.depth", None), "  depth:  4\n", ""), (("delete", "paths[0]", None), "  - src/a   # first\n", ""), (("delete", "limits.list[0]", None), "[1, 2,", "[2,"),
        (("delete", "limits.list[2]", None), "2,  3]", "2]"), (("pop", "paths", None), "  - deep:\n      x: 1\n      y: |\n        kept\n          as is\n", ""), (("set", "a.b.c", 1), "# end\n", "# end\na:\n  b:\n    c: 1\n"), (("set", "paths[2].deep.x", 2), "x: 1", "x: 2"),
        (("delete", "none.at.all", None), "", ""), (("set", "limits", 3), TEXT[TEXT.index("          # how much") : TEXT.index("\npaths")], " 3"),
    ],
)
def test_only_what_is_named_changes(edit, old, new):
    if edit[1] == "none.at.all":
        with pytest.raises(yaml_splice.NoSplice):
            spliced(TEXT, edit)
        return
    got = spliced(TEXT, edit)
    assert got == TEXT.replace(old, new, 1)
    root = yaml.safe_load(TEXT)
    assert yaml.safe_load(got) == editing._edited(root, edit[0], edit[1], edit[2])[0]


def test_what_a_splice_cannot_say_is_written_anew_with_the_same_meaning(spark):
    """Random edits of documents with comments, anchors and odd spacing: the text always means what plain edits of the document mean."""
    rng = random.Random(4)
    texts = [TEXT, "a: &x [1]\nb: *x\n", "- a: 1\n  b: 2\n- - x\n  - y\n", "only: 1 # c\n", "{}\n", "k: >\n  folded\n  text\n\n# after\nz: ~\n", "a: {b: {c: 1}} # c", "? odd\n: key\n", "'q': \"w\" # c\n\n\n"]
    paths = ["a", "a.b", "name", "limits.size", "limits.list", "limits.list[0]", "paths", "paths[0]", "paths[-1].deep.y", "last.a", "new.key", "b[0]", "k", "z", "only", "q", "[0].a", "limits", "x.y.z"]
    cases = [(rng.choice(texts), [(rng.choice(["set", "delete", "push", "pop"]), rng.choice(paths), rng.choice(["v", "12", "1.5", "a: b", "# no", ""])) for _ in range(3)]) for _ in range(160)]
    kept = 0
    for text, edits in cases:
        root = yaml.safe_load(text)
        try:
            for op, path, value in edits:
                root, _ = editing._edited(copy.deepcopy(root), op, path, editing._number(value))
        except (TypeError, KeyError, IndexError):
            continue
        got = spark.range(1).select(editing.edit_yaml(F.lit(text), edits).alias("e")).first().e.text if kept < 12 else None
        if got is None:
            got = plain_run(text, edits)
        assert yaml.safe_load(got) == root, (text, edits, got)
        kept += 1
    assert kept > 100


def plain_run(text, edits):
    """edit_yaml without Spark: its function on one text."""
    import pandas as pd

    return editing.edit_yaml.__globals__["_run_yaml"](pd.Series([text]), edits)["text"][0]


def test_comments_stay(spark):
    edits = [("set", "limits.size", "7"), ("push", "paths", "n"), ("delete", "empty", None), ("set", "fresh.key", "v")]
    got = spark.range(1).select(editing.edit_yaml(F.lit(TEXT), edits).alias("e")).first().e.text
    assert got == TEXT.replace("0x10 ", "7 ").replace("          as is\n", "          as is\n  - n\n").replace("empty:\n", "") + "fresh:\n  key: v\n"
