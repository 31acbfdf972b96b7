"""File events as a stream: matched by rules, debounced per path, handed to an import.

Two forms of the trailing debounce. By event time, a session window closes when a path has been quiet for the rule's
time; it works on batches and streams alike and its state is one row per open path. By processing time, a timer per
path is set again by each event and fires once, as live watching wants it.
"""

from __future__ import annotations

import datetime as dt
import os
import posixpath
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marrow.functions.text import base_name, glob_matches
from marrow.sources.markdown import list_files
from marrow.sources.state import WatchConfig, WatchRule

EVENTS = "path string, op string, ts timestamp"
#: Operations that make an import; others are ignored.
OPERATIONS = ("create", "write", "rename")


def under(path: Column, source: str) -> Column:
    return (path == source) | path.startswith(source.rstrip("/") + "/")


def rule_matches(rule: WatchRule, path: Column) -> Column:
    """Whether a path lies in a source of the rule and one of its patterns matches its name, its path below a source, or the whole path."""
    inside, named = F.lit(False), F.lit(False)
    for source in rule.sources:
        inside = inside | under(path, source)
    for pattern in rule.patterns:
        named = named | glob_matches(base_name(path), pattern) | glob_matches(path, pattern)
        for source in rule.sources:
            below = source.rstrip("/") + "/"
            named = named | (path.startswith(below) & glob_matches(F.substring(path, len(below) + 1, 1 << 30), pattern))
    return inside & named


def last_rule(config: WatchConfig, path: Column) -> Column:
    """Index of the last rule that matches, as later rules replace earlier ones; NULL if none does."""
    return F.array_max(F.array_compact(F.array(*(F.when(rule_matches(r, path), k) for k, r in enumerate(config.rules)))))


def matched(events: DataFrame, config: WatchConfig, every_rule: bool = False, operations: tuple[str, ...] = OPERATIONS) -> DataFrame:
    """Events that count, with ``rule`` (its index) and ``debounce_ms``; with ``every_rule`` one row per matching rule."""
    wanted = events.where(F.lower("op").isin(*operations))
    if every_rule:
        rules = F.array_compact(F.array(*(F.when(rule_matches(r, F.col("path")), k) for k, r in enumerate(config.rules))))
        with_rule = wanted.withColumn("rule", F.explode(rules))
    else:
        with_rule = wanted.withColumn("rule", last_rule(config, F.col("path"))).where("rule is not null")
    times = F.array(*(F.lit(r.debounce_ms) for r in config.rules))
    return with_rule.withColumn("debounce_ms", F.element_at(times, F.col("rule") + 1))


def target_of(rule: WatchRule, path: str) -> str:
    """Where a source comes to lie: its path below the source of its rule, its name for a source that is a file."""
    for source in rule.sources:
        if path == source:
            return posixpath.basename(path)
        rel = posixpath.relpath(path, source)
        if rel != ".." and not rel.startswith("../"):
            return rel
    return posixpath.basename(path)


def target_column(config: WatchConfig, path: Column, rule: Column) -> Column:
    """``target_of`` as a column: of the first source that holds the path, the part below it."""
    out = base_name(path)
    for k, r in enumerate(config.rules):
        for source in reversed(r.sources):
            below = source.rstrip("/") + "/"
            out = F.when((rule == k) & path.startswith(below), F.substring(path, len(below) + 1, 1 << 30)).when((rule == k) & (path == source), base_name(path)).otherwise(out)
    return out


def debounced(events: DataFrame, gap: Column | str, keys: tuple[str, ...] = ("path",), watermark: str | None = None) -> DataFrame:
    """One row per quiet-ended burst of each path: first and last time, how many events, the last operation.

    An event exactly ``gap`` after the last one still belongs to the burst. ``gap`` may differ from row to row.
    """
    rows = events.withWatermark("ts", watermark) if watermark else events
    return (
        rows.groupBy(*keys, F.session_window("ts", gap).alias("w"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max_by("op", "ts").alias("op"))
        .drop("w")
    )


def rule_gap() -> Column:
    """The gap of each row's rule, for ``debounced``."""
    return F.concat(F.col("debounce_ms").cast("string"), F.lit(" milliseconds"))


def debounced_live(events: DataFrame, gap_ms: int) -> DataFrame:
    """The debounce by processing time: a timer per path, set again by each event, carrying the last operation."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            op, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], op, n)], columns=["path", "op", "n"])
            return
        op, n = state.get if state.exists else (None, 0)
        newest = None
        for pdf in batches:
            n += len(pdf)
            row = pdf.sort_values("ts", kind="stable").iloc[-1]
            if newest is None or row["ts"] >= newest:
                newest, op = row["ts"], row["op"]
        state.update((op, n))
        state.setTimeoutDuration(gap_ms)

    return events.groupBy("path").applyInPandasWithState(step, "path string, op string, n long", "op string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def file_events(spark: SparkSession, folder: str, glob: str = "*.md", **options: Any) -> DataFrame:
    """New and rewritten files of a folder as events: path, op (create), ts and content."""
    reader = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("latestFirst", "false")
    for k, v in options.items():
        reader = reader.option(k, v)
    raw = reader.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), F.lit("create").alias("op"), F.col("modificationTime").alias("ts"), "content")


def start(events: DataFrame, config: WatchConfig, process: Callable[[DataFrame, int], None], checkpoint: str, **trigger: Any):  # noqa: ANN201
    """Hand each batch of matched events, the last of each path, to ``process``; what was pending is taken up after a restart."""

    def batch(df: DataFrame, epoch: int) -> None:
        process(_last_of_path(matched(df, config), config), epoch)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "300 milliseconds"})).start()


def _last_of_path(rows: DataFrame, config: WatchConfig) -> DataFrame:
    last = rows.groupBy("path").agg(F.max_by(F.struct("op", "rule", "ts"), F.struct("ts", "op")).alias("e")).select("path", "e.*")
    return last.withColumn("target", target_column(config, F.col("path"), F.col("rule")))


# --- removals and renames: a folder compared with what it was -------------------------------------------------------

LISTING = "path string, size long, mtime timestamp"


def listing(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(path, size, mtime) of all files of a folder; nothing is read of them."""
    root = os.path.abspath(folder.removeprefix("file://"))
    rows = [(f"{root}/{p}", size, dt.datetime.fromtimestamp(at, dt.UTC)) for p, size, at in list_files(root, suffix=suffix, any_case=True, hidden=True)]
    return spark.createDataFrame(rows, LISTING)


def listing_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, op, ts, renamed_to): what happened between two listings: create, write, remove, rename.

    A path that is gone was renamed if a new one has its size and time (of several the first in order of paths, each
    once); the new path is an event of its own, create, as file systems tell it. Times are those of the files.
    """
    now = after.select("path", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"), F.lit(True).alias("here"))
    both = before.select("path", "size", "mtime", F.lit(True).alias("was")).join(now, "path", "full")
    same = F.col("size").eqNullSafe(F.col("size_now")) & F.col("mtime").eqNullSafe(F.col("mtime_now"))
    op = F.when(F.col("was").isNull(), "create").when(F.col("here").isNull(), "remove").when(~same, "write")
    seen = both.withColumn("op", op).where("op is not null").select("path", "op", F.coalesce("size_now", "size").alias("size"), F.coalesce("mtime_now", "mtime").alias("ts"))
    nth = F.row_number().over(Window.partitionBy("op", "size", "ts").orderBy("path"))
    ordered = seen.withColumn("k", nth)
    moved = ordered.where("op = 'create'").select(F.lit("remove").alias("op"), "size", "ts", "k", F.col("path").alias("renamed_to"))
    found = ordered.join(moved, ["op", "size", "ts", "k"], "left")
    return found.select("path", F.when(F.col("renamed_to").isNotNull(), "rename").otherwise(F.col("op")).alias("op"), "ts", "renamed_to")


def start_listing(spark: SparkSession, folder: str, config: WatchConfig, process: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", suffix: str = ""):  # noqa: ANN201
    """Compare a folder with its last listing at each tick and hand the matched events, removals and renames too, to ``process``.

    The listing is kept in the checkpoint folder after ``process`` has ended, so what a broken run did not finish is
    told again after a restart.
    """
    places = f"{checkpoint.rstrip('/')}/listings"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(places)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())

    def known() -> list[int]:
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(hadoop) if s.getPath().getName().isdigit()) if fs.exists(hadoop) else []

    def tick(_: DataFrame, epoch: int) -> None:
        kept = known()
        before = spark.read.schema(LISTING).parquet(f"{places}/{kept[-1]}") if kept else spark.createDataFrame([], LISTING)
        number = (kept[-1] if kept else -1) + 1
        listing(spark, folder, suffix).write.mode("overwrite").parquet(f"{places}/next-{number}")
        after = spark.read.schema(LISTING).parquet(f"{places}/next-{number}")
        events = matched(listing_events(before, after), config, operations=(*OPERATIONS, "remove"))
        if not events.isEmpty():
            process(_last_of_path(events, config), epoch)
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{places}/next-{number}"), spark._jvm.org.apache.hadoop.fs.Path(f"{places}/{number}"))
        for old in kept[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{places}/{old}"), True)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", f"{checkpoint.rstrip('/')}/ticks").trigger(processingTime=every).start()
