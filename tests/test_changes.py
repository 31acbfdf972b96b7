import datetime as dt

import pytest
from pyspark.sql import functions as F

from marrow.operators import changes

T0 = dt.datetime(2024, 1, 1)


def test_detection(spark):
    listing = spark.createDataFrame([("same", 1, T0 + dt.timedelta(milliseconds=900)), ("touched", 1, T0 + dt.timedelta(seconds=5)), ("changed", 2, T0), ("new", 1, T0), ("unreadable", 9, T0)], "source_path string, size long, mtime timestamp")
    contents = spark.createDataFrame([("same", "DIFFERENT"), ("touched", "t"), ("changed", "c2"), ("new", "n")], "source_path string, content string")
    index = spark.createDataFrame([(p, f"t/{p}", c, 1, "merge") for p, c in (("same", "?"), ("touched", "t"), ("changed", "c"), ("gone", "g"), ("unreadable", "u"))], "source_path string, target_path string, text string, file_size long, strategy string")
    index = index.select("source_path", "target_path", F.sha2("text", 256).alias("content_hash"), F.lit(T0).alias("last_modified"), F.lit(T0).alias("last_imported"), "file_size", "strategy", F.array().cast("array<string>").alias("patch_fields"), F.lit(True).alias("source_exists"))
    d = changes.detect(listing, contents, index)
    assert {r["source_path"]: r["result"] for r in d.collect()} == {"same": "no_change", "touched": "meta_changed", "changed": "content_changed", "new": "new_file", "gone": "source_missing", "unreadable": "content_changed"}
    after = {r["source_path"]: r for r in changes.updated_index(index, d, F.lit(T0 + dt.timedelta(days=1)), F.col("source_path")).collect()}
    assert after["gone"]["source_exists"] is False and after["new"]["target_path"] == "new" and after["touched"]["last_imported"] == T0
    assert after["changed"]["file_size"] == 2 and after["changed"]["strategy"] == "merge"
    assert changes.counters(d).first()["total"] == 6
    assert changes.detect(listing.limit(0), contents, index.limit(0)).count() == 0
    kept = changes.prune_missing(index.unionByName(index.limit(1).withColumn("source_path", F.lit("a.zip::gone"))), d)
    assert "gone" not in {r["source_path"] for r in kept.collect()} and "a.zip::gone" in {r["source_path"] for r in kept.collect()}


def apply(spark, source, target, strategy, fields=None, forced=""):
    df = spark.createDataFrame([(source, target, strategy, fields)], "source string, target string, strategy string, patch_fields array<string>")
    r = changes.apply_strategies(df, forced).first()
    return r["used"], r["changed"], r["result"]


def test_strategies(spark):
    s, t = "---\ntitle: S\nnew: 1\ntags:\n  - b\n  - a\n---\nsource", "---\ntitle: 'T'\ntags: c\n---\n\ntarget"
    assert apply(spark, s, t, "merge") == ("merge", True, "---\nnew: 1\ntags:\n  - a\n  - b\n  - c\ntitle: T\n---\ntarget\n")
    assert apply(spark, s, t, "patch") == ("patch", True, "---\ntags:\n  - b\n  - a\ntitle: S\n---\ntarget\n")
    assert apply(spark, s, t, "patch", ["new"]) == ("patch", True, "---\nnew: 1\ntags: c\ntitle: T\n---\ntarget\n")
    assert apply(spark, s, t, "") == ("skip", False, t) and apply(spark, s, t, "merge", forced="overwrite") == ("overwrite", True, s)
    assert apply(spark, s, None, "skip") == ("skip", True, s)
    assert apply(spark, "plain", "other", "merge") == ("merge", True, "other") and apply(spark, "same", "same", "merge") == ("merge", False, "same")
    assert apply(spark, "plain", "other", "patch") == ("patch", False, "other")
    done = "---\ntitle: T\n---\nbody\n"
    assert apply(spark, "---\ntitle: S\n---\n", done, "merge") == ("merge", False, done)
    crlf = "---\r\ntitle: S\r\nlist: [a, b]\r\n---\r\nbody"
    assert apply(spark, crlf, "x", "merge") == ("merge", True, "---\nlist: [a, b]\ntitle: S\n---\nx\n")
    # a fence that never closes is no frontmatter
    assert apply(spark, "---\ntitle: S\n", "x", "patch") == ("patch", False, "x")
    with pytest.raises(ValueError):
        apply(spark, s, t, "merge", forced="other")


def test_index_operations(spark):
    index = spark.createDataFrame([("s", "t")], "source_path string, target_path string")
    other = spark.createDataFrame([("s2", "t2")], "source_path string, target_path string")
    both = changes.add_to_index(index, other)
    assert both.count() == 2 and changes.delete_from_index(both, other).count() == 1
    with pytest.raises(ValueError):
        changes.add_to_index(index, index)
    with pytest.raises(ValueError):
        changes.replace_in_index(index, other)
    assert changes.replace_in_index(index, index.withColumn("source_path", F.lit("x"))).first()["source_path"] == "x"


def test_upsert(make_concepts, spark):
    old = make_concepts({"title": "stay", "resource": "code://repo/stay.go"}, {"title": "old", "resource": "code://repo/old.go"}, {"title": "free", "file_path": ""}, {"title": "index", "type": "code_relation_index"}, {"title": "by path", "file_path": "p.md"})
    new = make_concepts({"title": "stay 2", "resource": "code://repo/stay.go"}, {"type": "deleted", "resource": "old.go"}, {"title": "new", "resource": "code://repo/new.go"}, {"title": "by path 2", "file_path": "p.md"})
    assert sorted(r["title"] for r in changes.upsert(old, new).collect()) == ["by path 2", "free", "new", "stay 2"]
    c = make_concepts({"resource": "code://repo/a.go", "custom": {"generated": "true", "generator": "kb.git", "source_path": "a.go"}}, {"resource": "code://repo/a.go", "custom": {"generated": "true", "generator": "kb.git", "source_path": "b.go"}})
    assert [r["ord"] for r in c.where(changes.trusted_to_delete("kb.git")).collect()] == [0]
