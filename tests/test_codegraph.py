import pytest
from pyspark.sql import functions as F

from marrow.functions.golang import GoSyntaxError, parse
from marrow.operators import codegraph

GO = '''package main

import (
	"fmt"
	alias "ext/x"
)

// StartServer in a comment: func Not() {}
func StartServer(a int) (int, error) {
	s := `func Raw() {}`
	return 0, nil
}

func (s *Server[T]) Run() { fmt.Println("}") }

type (
	Server[T any] struct {
		a int
	}
	handler interface{ Do() }
)

type ID = int
'''


def test_go_parser():
    imports, names, symbols = parse(GO)
    assert imports == ["fmt", "ext/x"]
    assert names == ["StartServer", "(*Server).Run", "struct Server", "interface handler", "type ID"]
    assert [(s["kind"], s["name"], s["receiver"], s["exported"], s["start_line"], s["end_line"]) for s in symbols] == [
        ("function", "StartServer", "", True, 9, 12), ("method", "Run", "Server", True, 14, 14), ("struct", "Server", "", True, 17, 19), ("interface", "handler", "", False, 20, 20), ("type", "ID", "", True, 23, 23),
    ]
    assert {s["package"] for s in symbols} == {"main"}
    for bad in ("", "func x() {}", "package a\nfunc ( {", "package a\nfoo bar"):
        with pytest.raises(GoSyntaxError):
            parse(bad)


@pytest.fixture
def files(spark):
    rows = [
        ("demo", "cmd/server/main.go", None, GO), ("demo", "bad.go", None, 'package x\nimport "a"\nfunc Broken( {\nfunc Fine() {'), ("demo", "a.py", 7, "import os\nfrom x.y import z\nimport os\nclass A:\n  def f(self): pass\n"),
        ("demo", "e.rb", None, None), ("demo", "n.txt", None, ""),
    ]
    return spark.createDataFrame(rows, "repository_id string, path string, size long, content string")


def test_summaries(files):
    got = {r["path"]: r for r in codegraph.summaries(files).collect()}
    assert got["a.py"]["imports"] == ["os", "x.y"] and got["a.py"]["functions"] == ["A", "f"] and got["a.py"]["line_count"] == 5
    assert got["bad.go"]["imports"] == ["a"] and got["bad.go"]["functions"] == ["Broken", "Fine"] and len(got["bad.go"]["warnings"]) == 1 and got["bad.go"]["symbols"] == []
    assert got["cmd/server/main.go"]["type"] == "go" and got["cmd/server/main.go"]["size"] == len(GO)
    assert got["e.rb"]["line_count"] == 0 and got["n.txt"]["type"] == "txt"


def test_index_and_round_trip(files):
    s = codegraph.summaries(files).where("path = 'cmd/server/main.go'")
    ids = {r["entity_id"] for r in codegraph.entities(s).collect()}
    assert "code:demo:cmd/server/main.go#symbol:function:main.StartServer@L9-L12" in ids
    assert {"code:demo:demo#repository:demo", "code:demo:main#package:main", "code:demo:cmd/server/main.go#import:fmt"} <= ids
    relations = codegraph.relations(s)
    ends = {r["target_id"] for r in relations.collect()} | {r["source_id"] for r in relations.collect()}
    assert ends <= ids and relations.count() == 3 + 2 + 2 * 5
    back = codegraph.summaries_of(codegraph.concepts_of(s)).first()
    first = s.first()
    assert back["imports"] == first["imports"] and [tuple(x) for x in back["symbols"]] == [tuple(x) for x in first["symbols"]]
    graph = {(r["kind"], r["source"], r["target"], r["meta"]) for r in codegraph.relationship_graph(s).collect()}
    assert ("package_owns_symbol", "main", "Server.Run", "method") in graph and ("file_import", "cmd/server/main.go", "fmt", "") in graph
    lines = {r["line"] for r in codegraph.relationship_lines(codegraph.relationship_graph(s.limit(0))).collect()}
    assert lines == {"- None"}


def test_map_edges(spark):
    nodes = spark.createDataFrame([("n1", "function", "f", "p.f", "a.go")], "id string, kind string, name string, qualified_name string, file_path string")
    for c in ("language", "docstring", "signature", "visibility"):
        nodes = nodes.withColumn(c, F.lit(""))
    for c in ("start_line", "end_line", "start_column", "end_column"):
        nodes = nodes.withColumn(c, F.lit(None).cast("int"))
    e = codegraph.map_nodes(nodes.withColumn("is_exported", F.lit(None).cast("boolean")).withColumn("repository_id", F.lit("")))
    edges = spark.createDataFrame([("n1", "lost", "calls", 3, 1, {"b": "2", "a": "1"}, "x"), ("n1", "n1", "calls", None, None, None, "")], "source string, target string, kind string, line int, column int, metadata map<string,string>, provenance string")
    got = {r["target_ref"]: r for r in codegraph.map_edges(edges, e).collect()}
    assert got["lost"]["source_id"] == "code:repo:a.go#symbol:function:p.f" and got["lost"]["target_id"] == "" and got["lost"]["metadata"] == "a=1; b=2; codegraph_provenance=x"
    assert got[""]["target_id"] == "code:repo:a.go#symbol:function:p.f" and got[""]["line_no"] == 0


def test_repository_id():
    assert codegraph.repository_id("/x/my repo") == "my-repo" and len(codegraph.repository_id("/")) == 12
