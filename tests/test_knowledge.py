from pyspark.sql import functions as F

from marrow.operators import bundle, context, lint, predicates, rank
from marrow.operators.predicates import Query


def ords(df):
    return sorted(r["ord"] for r in df.select("ord").collect())


def test_filters(make_concepts):
    c = make_concepts(
        {"type": "table", "title": "Users", "tags": ["pii", "core", "pii"], "resource": "DB://users", "content": "- Language: `go`\n- `function` `pkg.Load` (exported) at `a.go:1-2`"},
        {"type": "api", "title": "Orders", "tags": ["core"], "description": "É orders", "custom": {"language": "Go", "qualified_name": "x.Y"}},
        {"type": "", "title": "Guide", "tags": None, "content": None},
    )
    assert ords(Query(type="table").execute(c)) == [0]
    assert ords(Query(tags=("core", "pii")).execute(c)) == [0]
    assert ords(Query(resource="db://").execute(c)) == [0]
    assert ords(Query(text="é ORD").execute(c)) == [1]
    assert ords(Query(code_language=" GO ").execute(c)) == [0, 1]
    assert ords(Query(code_qualified_name="load").execute(c)) == [0]
    assert ords(Query(title_regex="^[UG]").execute(c)) == [0, 2]
    assert ords(Query(title_regex="(").execute(c)) == []
    assert ords(Query().execute(c)) == [0, 1, 2]
    assert Query(type="a", tags=("b",)).active() == 2
    assert ords(predicates.indexed_by_tag(c, "pii")) == [0, 0] and ords(predicates.by_tag(c, "pii")) == [0]
    assert ords(predicates.indexed_by_type(c, "")) == [] and ords(predicates.by_type(c, "")) == [2]
    assert ords(predicates.search_ascii(c, "é ord")) == [] and ords(predicates.search(c, "É ORD")) == [1]
    hit = predicates.search_with_matches(c, "load").first()
    assert [s["name"] for s in hit["symbol_matches"]] == ["pkg.Load"]
    assert ords(predicates.dispatch_search(c, "users", code_language="rust")) == [] and ords(predicates.dispatch_search(c, "users", legacy=True, code_language="rust")) == [0]


def test_bundle(make_concepts, spark):
    c = make_concepts({"title": "A", "tags": ["x"]}, {"title": "B", "resource": "r"}, {"title": "A", "resource": "r"}, {"title": "C", "tags": ["x", "x"]})
    assert ords(bundle.get_concept(c, "A")) == [0] and ords(bundle.get_concept(c, "Z")) == []
    assert ords(bundle.remove_concept(c, "A")) == [1, 2, 3] and ords(bundle.remove_concept(c, "Z")) == [0, 1, 2, 3]
    related = {(r["query_ord"], r["ord"]) for r in bundle.related_to(c, c).collect()}
    assert related == {(0, 3), (3, 0), (1, 2), (2, 1)}
    assert bundle.stats(c).first().asDict() == {"n_concepts": 4, "n_types": 1, "n_tags": 1}
    assert {r["tag"]: r["n"] for r in bundle.tag_counts(c).collect()} == {"x": 3}
    empty = c.limit(0)
    assert bundle.stats(empty).first().asDict() == {"n_concepts": 0, "n_types": 0, "n_tags": 0}
    generated = {"generated": "true", "generator": "g", "source_path": "a.go"}
    d = make_concepts({"type": "code_file", "custom": generated, "resource": "q"}, {"type": "code_file", "custom": {**generated, "generated": "false"}, "resource": "q"})
    got = bundle.collapse_overlays(bundle.overlay(d, d))
    assert sorted((r["source_rank"], r["ord"], len(r["duplicate_sources"] or [])) for r in got.collect()) == [(0, 0, 1), (0, 1, 0), (1, 1, 0)]


def test_ranking_order_and_reasons(make_concepts):
    shared = {"type": "code_symbol", "title": "SharedSymbol"}
    c = make_concepts(
        shared | {"custom": {"source_path": "zeta.go", "start_line": "30"}}, shared | {"custom": {"source_path": "alpha.go", "start_line": "40", "end_line": "41"}}, shared | {"custom": {"source_path": "alpha.go", "start_line": "10"}},
        {"title": "other", "content": "a sharedsymbol here"},
    )
    rows = rank.ranked(c, " sharedSYMBOL ", 10).orderBy("rank").collect()
    assert [r["location"] for r in rows] == ["alpha.go:10", "alpha.go:40-41", "zeta.go:30", ""]
    assert [r["score"] for r in rows] == [200, 200, 200, 10]
    assert rows[0]["reason"] == "exact symbol match, exact title match" and rows[3]["reason"] == "content match"
    assert rows[0]["provenance"] == "kb.code" and rows[3]["provenance"] == "kb.markdown"
    every = rank.ranked(c, "sharedsymbol", 0).orderBy("rank").collect()
    assert [r["ord"] for r in every] == [2, 1, 0, 3] and [r["rank"] for r in every] == [1, 2, 3, 4]
    many = rank.best_of_each(rank.many(c, [(7, "other"), (8, "nothing at all")]), 3).collect()
    assert [(r["query_id"], r["ord"]) for r in many] == [(7, 3)]
    steps = rank.trace(c, "sharedsymbol", 2, {"type": ""}, ["p"])
    assert [s["type"] for s in steps] == ["path_resolution", "bundle_load", "overlay_merge", "filter_application", "candidate_scoring", "ranking"]
    assert steps[4]["counts"] == {"matches": 4} and steps[4]["score_delta"] == 200 and steps[5]["counts"] == {"returned": 2}
    assert rank.ranked(c.limit(0), "x", 5).count() == 0


def test_lint(make_concepts):
    long = "\n".join(["x" * 241] * 8)
    c = make_concepts(
        {"type": "", "title": "test"}, {"type": "Bad Type", "title": "test", "tags": ["Upper Case", "b", "b", "b"], "description": "long enough", "timestamp": "2024-02-30", "content": long},
        {"title": "fine", "description": "long enough", "timestamp": "2024-01-15T10:30:00.5Z", "content": "body", "tags": ["a"]},
    )
    got = {}
    for r in lint.lint(c, lint.Config(required_tags=("a",))).collect():
        got.setdefault(r["ord"], []).append((r["code"], r["line"]))
    assert sorted(got[0]) == [("KB001", 1), ("KB003", 3), ("KB005", 6), ("KB007", 8), ("KB011", 5), ("KB013", 0)]
    assert sorted(got[1]) == [("KB004", 1), ("KB005", 6), ("KB006", 5), ("KB006", 5), *[("KB009", 8 + k) for k in range(6)], ("KB010", 5), ("KB011", 5), ("KB013", 0)]
    assert 2 not in got
    assert not lint.passes(lint.lint(c)) and lint.passes(lint.lint(c.where("ord = 2")), strict=True)
    assert lint.summary(lint.lint(c.limit(0))).first().asDict() == {"errors": 0, "warnings": 0, "infos": 0}
    # concepts that are delivered again count once
    assert lint.lint(c.union(c)).count() == lint.lint(c).count()


def candidate(path, a, b, score=10, reason="r"):
    return context.Candidate(path, a, b, [{"title": path, "type": "t", "score": score, "reason": reason, "provenance": "p"}])


def test_range_merge_is_greedy():
    got = context.merge_ranges([candidate("f", 1, 2), candidate("f", 5, 6), candidate("f", 3, 4, reason="s")])
    assert [(c.start, c.end) for c in got] == [(1, 4), (5, 6)]
    assert got[0].reason() == "merged 2 hits: r; s"


def test_snippets():
    text = "\n".join(f"line {k}" for k in range(1, 11))
    assert context.snippet(text, "", 5, 7, 100)[:3] == ("\n".join(f"line {k}" for k in range(4, 9)), 4, 8)
    assert context.snippet(text, "", 5, 7, 6)[:3] == ("line 5\nline 6\nline 7", 5, 7)
    assert context.snippet(text, "", 5, 7, 2)[0] == ""
    assert context.snippet("a\nb\n\n", "", 2, 2, 10)[:3] == ("a\nb", 1, 2)
    assert context.snippet("x" * 50 + "Key" + "y" * 50, "key", 0, 0, 4) == ("x" * 6 + "Key" + "y" * 7, 1, 1, 0)
    assert context.snippet(text, "absent", 0, 0, 9) == ("", 0, 0, 10)


def test_packing_skips_and_goes_on():
    sources = {"a": "a" * 40, "b": "b" * 400, "c": "c" * 20}
    p = context.pack([candidate("a", 1, 1), candidate("b", 1, 1), candidate("c", 1, 1), candidate("gone", 1, 1), candidate("../x", 1, 1), candidate("", 0, 0)], sources, "q", 15)
    assert [i["source_path"] for i in p.items] == ["a", "c"] and p.used == 15
    assert [o["reason"] for o in p.omissions] == ["snippet_empty", "budget_exceeded"] and p.omissions[1]["count"] == 3
    q = context.pack([candidate("gone", 1, 1), candidate("../x", 1, 1), candidate("", 0, 0)], sources, "q", 15)
    assert [o["reason"] for o in q.omissions] == ["source_missing", "source_path_escapes_repo", "no_source_path"] and len(q.items) == 1
    many = context.pack([candidate(f"p{k}", 1, 1) for k in range(52)], {}, "q", 5)
    assert many.omissions[0] == {"reason": "candidate_limit_exceeded", "title": "", "source_path": "", "count": 2}


def test_context_with_relations(make_concepts, spark):
    c = make_concepts(
        {"type": "code_symbol", "title": "Alpha", "custom": {"source_path": "alpha.go", "start_line": "1", "end_line": "1"}}, {"type": "code_symbol", "title": "Beta", "custom": {"source_path": "beta.go", "start_line": "2", "end_line": "2"}},
        {"type": "code_relation", "title": "rel", "custom": {"relation_kind": "calls", "relation_source": "alpha.go", "relation_target": "./beta.go"}},
    )
    sources = spark.createDataFrame([("alpha.go", "func Alpha"), ("beta.go", "one\nfunc Beta")], "path string, content string")
    plain = context.packs(c, sources, [(0, "Alpha")], 100).where("kind = 'item'").orderBy("seq").collect()
    assert [r["source_path"] for r in plain] == ["alpha.go"]
    both = context.packs(c, sources, [(0, "Alpha")], 100, include_relations=True).where("kind = 'item'").orderBy("seq").collect()
    assert [r["source_path"] for r in both] == ["alpha.go", "beta.go"] and both[1]["reason"] == "relation calls from alpha.go to beta.go"


def test_column_snippet_is_the_fold(spark):
    texts = ["a\nb\nc\nd", "a\r\nb\r\n\r\nd", "", "one", "x" * 100 + "\n" + "y" * 100, "a\n\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for a, b, budget in ((1, 1, 50), (2, 3, 50), (2, 2, 10), (3, 9, 50)):
        got = {r["i"]: r["s"] for r in df.select("i", context.range_snippet(F.col("t"), F.lit(a), F.lit(b), F.lit(budget)).alias("s")).collect()}
        assert got == {i: context.snippet(t, "", a, b, budget)[0] for i, t in enumerate(texts)}, (a, b, budget)
