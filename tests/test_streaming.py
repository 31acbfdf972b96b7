import time
import datetime as dt

from pyspark.sql import functions as F

from marrow.sources.state import watch_config
from marrow.streaming import watch

T0 = dt.datetime(2024, 1, 1)
CONFIG = watch_config({"rules": [{"sources": ["/s"]}, {"sources": ["/s/docs", "/one/f.md"], "strategy": "patch", "debounce": "2s", "patterns": ["*.md"]}]}, "/")


def events(spark, *rows):
    return spark.createDataFrame([(p, op, T0 + dt.timedelta(seconds=t)) for p, op, t in rows], watch.EVENTS)


def test_rules(spark):
    e = events(spark, ("/s/a.md", "write", 0), ("/s/docs/b.md", "create", 0), ("/s2/c.md", "write", 0), ("/s/d.txt", "write", 0), ("/s/a.md", "remove", 1), ("/one/f.md", "RENAME", 0))
    got = {(r["path"], r["rule"], r["debounce_ms"], r["target"]) for r in watch.matched(e, CONFIG).withColumn("target", watch.target_column(CONFIG, F.col("path"), F.col("rule"))).collect()}
    assert got == {("/s/a.md", 0, 300, "a.md"), ("/s/docs/b.md", 1, 2000, "b.md"), ("/one/f.md", 1, 2000, "f.md")}
    assert watch.matched(e, CONFIG, every_rule=True).count() == 4
    assert watch.target_of(CONFIG.rules[0], "/s/x/y.md") == "x/y.md" and watch.target_of(CONFIG.rules[1], "/one/f.md") == "f.md" and watch.target_of(CONFIG.rules[1], "/else/g.md") == "g.md"


def test_debounce(spark):
    e = events(spark, ("a", "create", 0), ("a", "write", 10), ("a", "write", 20.5), ("b", "write", 5))
    got = sorted((r["path"], r["n"], r["op"], (r["last_ts"] - T0).total_seconds()) for r in watch.debounced(e, "10 seconds").collect())
    assert got == [("a", 1, "write", 20.5), ("a", 2, "write", 10.0), ("b", 1, "write", 5.0)]
    by_rule = watch.matched(events(spark, ("/s/a.md", "write", 0), ("/s/a.md", "write", 1), ("/s/docs/a.md", "write", 0), ("/s/docs/a.md", "write", 1)), CONFIG)
    assert sorted(r["n"] for r in watch.debounced(by_rule, watch.rule_gap()).collect()) == [1, 1, 2]
    assert watch.debounced(e.limit(0), "1 second").count() == 0


def test_stream_and_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    src = spark.readStream.schema(watch.EVENTS).json(str(folder))
    seen = []

    def process(df, epoch):
        seen.extend((r["path"], r["op"], r["target"]) for r in df.collect())

    def feed(name, *rows):
        (folder / name).write_text("".join(f'{{"path":"{p}","op":"{op}","ts":"2024-01-01T00:00:{t:02d}Z"}}\n' for p, op, t in rows))
        watch.start(src, CONFIG, process, str(tmp_path / "cp"), availableNow=True).awaitTermination()

    feed("1.json", ("/s/a.md", "create", 0), ("/s/a.md", "write", 1), ("/x/b.md", "write", 0))
    feed("2.json", ("/s/docs/c.md", "write", 2))
    assert seen == [("/s/a.md", "write", "a.md"), ("/s/docs/c.md", "write", "c.md")]


def test_live_debounce(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"path":"a","op":"create","ts":"2024-01-01T00:00:00Z"}\n{"path":"a","op":"write","ts":"2024-01-01T00:00:01Z"}\n')
    src = spark.readStream.schema(watch.EVENTS).json(str(folder))
    q = watch.debounced_live(src, 500).writeStream.format("memory").queryName("live").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        rows = []
        for _ in range(60):  # timers run on by themselves, so the query is never idle
            q.awaitTermination(1)
            if rows := spark.table("live").collect():
                break
        assert [(r["path"], r["op"], r["n"]) for r in rows] == [("a", "write", 2)]
    finally:
        q.stop()


def test_file_events(spark, tmp_path):
    (tmp_path / "x.md").write_text("hello")
    q = watch.file_events(spark, str(tmp_path)).writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("files").first()
    assert r["path"].endswith("/x.md") and bytes(r["content"]) == b"hello" and r["op"] == "create"


def test_listing_events(spark):
    at = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)
    before = spark.createDataFrame([("/s/a.md", 1, at(1)), ("/s/b.md", 2, at(2)), ("/s/c.md", 3, at(3)), ("/s/d.md", 4, at(4)), ("/s/e1", 5, at(5)), ("/s/e2", 5, at(5))], watch.LISTING)
    after = spark.createDataFrame([("/s/a.md", 1, at(1)), ("/s/b.md", 2, at(9)), ("/s/moved.md", 3, at(3)), ("/s/new.md", 4, at(8)), ("/s/f1", 5, at(5))], watch.LISTING)
    got = {r["path"]: (r["op"], r["renamed_to"]) for r in watch.listing_events(before, after).collect()}
    assert got == {"/s/b.md": ("write", None), "/s/c.md": ("rename", "/s/moved.md"), "/s/moved.md": ("create", None), "/s/d.md": ("remove", None), "/s/new.md": ("create", None), "/s/e1": ("rename", "/s/f1"), "/s/e2": ("remove", None), "/s/f1": ("create", None)}
    assert watch.listing_events(before, before).count() == 0 and watch.listing_events(before.limit(0), before).count() == 6
    rules = {r["path"]: r["op"] for r in watch.matched(watch.listing_events(before, after), CONFIG, operations=("remove", "rename")).collect()}
    assert rules == {"/s/c.md": "rename", "/s/d.md": "remove"}


def test_removals_and_renames_reach_the_rules(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("a")
    (folder / "b.md").write_text("bb")
    config = watch_config({"rules": [{"sources": [str(folder)]}]}, "/")
    seen: list[tuple] = []
    query = watch.start_listing(spark, str(folder), config, lambda df, _: seen.extend((r["target"], r["op"]) for r in df.collect()), str(tmp_path / "state"), every="200 milliseconds")
    wait = lambda done: next((True for _ in range(300) if done() or time.sleep(0.1)), False)
    try:
        assert wait(lambda: len(seen) >= 2)
        (folder / "a.md").unlink()
        assert wait(lambda: ("a.md", "remove") in seen)
        (folder / "b.md").rename(folder / "c.md")
        assert wait(lambda: {("b.md", "rename"), ("c.md", "create")} <= set(seen))
    finally:
        query.stop()
    assert sorted(seen) == [("a.md", "create"), ("a.md", "remove"), ("b.md", "create"), ("b.md", "rename"), ("c.md", "create")]
