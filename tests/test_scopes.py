"""Scope trees and references: nesting, receivers, heredocs, strings, and what names resolve to."""

from loomstead.functions import scopes

PHP = """<?php
use App\\Models\\User;
class Box extends Base {
    // function hidden() {
    public function open($a) {
        $x = <<<EOT
function fake() { "
EOT;
        return $this->lid(strlen($a)) . "}" . helper($x);
    }
    private static function lid($v) { return new User($v); }
}
trait Shared {
    function part() { return Box::lid(1); }
}
function helper($v) {
    return $v;
}
"""
GO = '''package a

import (
	"fmt"
	h "net/http"
)

func (b *Box) Open(n int) string {
	run := func() { fmt.Println("{ fake(") }
	run()
	return b.lid(n) + process() // other()
}

type Box struct {
	c http.Client
}

func (b Box) lid(n int) string { return `{ }` }

func process() string {
	if true {
		return process()
	}
}
'''
PY = '''import os.path
from a.b import c

class Outer:
    """def not_one(): {"""
    class Inner(Base):
        def go(self, x: Thing) -> Other:
            return self.stop(x, "f(") + helper(y)  # call_me()

        def stop(self):
            def deep():
                return stop2()
            return deep()

def helper(v):
    return Outer(v)
'''


def tree(text, language):
    return [(x["type"], x["scope"], x["start"], x["end"]) for x in scopes.scope_tree(text, language)]


def refs(text, language):
    return sorted(scopes.scope_references(text, language), key=str)


def test_php():
    assert tree(PHP, "php") == [("struct", "Box", 3, 12), ("method", "Box.open", 5, 10), ("method", "Box.lid", 11, 11), ("struct", "Shared", 13, 15), ("method", "Shared.part", 14, 14), ("function", "helper", 16, 18)]
    assert refs(PHP, "php") == sorted(
        [
            ("Box", "imports", "User", None, 2), ("Box", "uses_type", "Base", None, 3), ("Box.open", "calls", "this.lid", "Box.lid", 9), ("Box.open", "calls", "strlen", None, 9), ("Box.open", "calls", "helper", "helper", 9),
            ("Box.lid", "uses_type", "User", None, 11), ("Box.lid", "calls", "User", None, 11), ("Shared.part", "calls", "Box.lid", None, 14),
        ], key=str,
    )


def test_go():
    assert tree(GO, "go") == [("method", "Box.Open", 8, 12), ("struct", "Box", 14, 16), ("method", "Box.lid", 18, 18), ("function", "process", 20, 24)]
    assert refs(GO, "go") == sorted(
        [
            ("Box.Open", "imports", "fmt", None, 4), ("Box.Open", "imports", "h", None, 5), ("Box.Open", "calls", "fmt.Println", None, 9), ("Box.Open", "uses_type", "fmt.Println", None, 9), ("Box.Open", "calls", "run", None, 10),
            ("Box.Open", "calls", "b.lid", "Box.lid", 11), ("Box.Open", "calls", "process", "process", 11), ("Box", "uses_type", "http.Client", None, 15),
        ], key=str,
    )


def test_python():
    assert tree(PY, "python") == [("struct", "Outer", 4, 13), ("struct", "Outer.Inner", 6, 13), ("method", "Outer.Inner.go", 7, 8), ("method", "Outer.Inner.stop", 10, 13), ("method", "Outer.Inner.stop.deep", 11, 12), ("function", "helper", 15, 16)]
    assert refs(PY, "python") == sorted(
        [
            ("Outer", "imports", "os.path", None, 1), ("Outer", "imports", "a.b", None, 2), ("Outer.Inner.go", "uses_type", "Thing", None, 7), ("Outer.Inner.go", "uses_type", "Other", None, 7),
            ("Outer.Inner.go", "calls", "self.stop", "Outer.Inner.stop", 8), ("Outer.Inner.go", "calls", "helper", "helper", 8), ("Outer.Inner.stop.deep", "calls", "stop2", None, 12),
            ("Outer.Inner.stop", "calls", "deep", "Outer.Inner.stop.deep", 13), ("helper", "calls", "Outer", "Outer", 16),
        ], key=str,
    )


def test_files_of_a_table(spark):
    rows = [("a/b.php", PHP), ("x.GO", GO), ("m.py", PY), ("n.md", "# one"), ("e.py", ""), ("f.go", None), (None, "def f(): pass"), ("g.py", "x = f(1)\nimport z")]
    files = spark.createDataFrame(rows, "path string, text string")
    found = scopes.file_scopes(files)
    assert sorted({r.path for r in found.collect()}) == ["a/b.php", "m.py", "x.GO"] and found.count() == 16
    assert found.where("scope = 'Outer.Inner.go'").first().asDict() == {"path": "m.py", "scope": "Outer.Inner.go", "parent": "Outer.Inner", "type": "method", "name": "go", "start_line": 7, "end_line": 8, "depth": 2, "language": "python"}
    told = scopes.file_references(files)
    assert sorted(tuple(r) for r in told.where("path = 'g.py'").collect()) == [("g.py", "", "calls", "f", None, 1), ("g.py", "", "imports", "z", None, 2)]
    assert scopes.file_scopes(files.limit(0)).count() == 0
