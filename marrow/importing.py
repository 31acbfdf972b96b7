"""Importing documents into a knowledge folder: detection, strategies and index in one set-oriented pass.

Sources are files, folders or archives. What has to be read is decided from the listing alone; texts and their targets
are joined, merged as columns, and written by the executors. The index is updated last, so a broken run is repeated.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions.session import written
from marrow.operators import changes
from marrow.sources import archives
from marrow.sources.markdown import list_files, validate_lenient, validate_strict

SOURCES = "source_path string, target_path string, size long, mtime timestamp, file string"


def list_sources(spark: SparkSession, paths: list[str], keep_dir: bool = False) -> DataFrame:
    """(source_path, target_path, size, mtime, file) of files and folders; entries of archives are ``archive::entry`` with their text.

    With ``keep_dir`` targets keep the name of a source folder.
    """
    rows = []
    for p in map(os.path.abspath, paths):
        stamp = lambda t: dt.datetime.fromtimestamp(t, dt.UTC)
        if os.path.isdir(p):
            prefix = os.path.basename(p) + "/" if keep_dir else ""
            rows += [(os.path.join(p, f), prefix + f, s, stamp(m), os.path.join(p, f)) for f, s, m in list_files(p, any_case=True, hidden=True)]
        elif archives.is_archive(p) and os.path.exists(p):
            s = os.stat(p)
            rows += [(f"{p}::{os.path.normpath(n)}", os.path.normpath(n), len(d), stamp(s.st_mtime), p) for n, d in archives.entries(p)]
        elif os.path.exists(p):
            s = os.stat(p)
            rows.append((p, os.path.basename(p), s.st_size, stamp(s.st_mtime), p))
    return spark.createDataFrame(rows, SOURCES)


def read_texts(listed: DataFrame) -> DataFrame:
    """(source_path, content) of listed sources that can be read; an archive is opened once for all of its entries in a batch."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, group in pdf.groupby("file"):
                inside = {n: d for n, d in ((os.path.normpath(n), d) for n, d in archives.entries(file))} if "::" in group["source_path"].iloc[0] else None
                for source in group["source_path"]:
                    try:
                        if inside is None:
                            with open(file, "rb") as f:
                                data = f.read()
                        else:
                            data = inside[source.partition("::")[2]]
                        out.append((source, data.decode("utf-8", "replace")))
                    except (OSError, KeyError):
                        continue
            yield pd.DataFrame(out, columns=["source_path", "content"])

    return listed.select("source_path", "file").mapInPandas(read, "source_path string, content string")


def validated(strict: bool):  # noqa: ANN201
    """A column function that tells why a text is no document, or nothing."""
    check = validate_strict if strict else validate_lenient

    def validate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: check(t or ""))

    return F.pandas_udf(validate, "string")


def _targets(kb_dir: str):  # noqa: ANN202
    def read(paths: pd.Series) -> pd.Series:
        out = []
        for p in paths:
            try:
                with open(os.path.join(kb_dir, p), encoding="utf-8", errors="replace", newline="") as f:
                    out.append(f.read())
            except OSError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(read, "string")


def plan_import(listed: DataFrame, index: DataFrame, kb_dir: str, forced: str = "", patch_fields: list[str] | None = None, strict: bool = False) -> DataFrame:
    """What an import does with each source: result, strategy used, new text, whether it changes the target, and why it fails.

    A new file is copied if its frontmatter can be read; a target that another source owns fails instead of being
    overwritten.
    """
    texts = read_texts(listed)
    detected = written(changes.detect(listed.select("source_path", "size", "mtime"), texts, index).withColumnRenamed("target_path", "known_target"), "detected")
    todo = detected.where(F.col("result").isin(changes.NEW, changes.CONTENT)).join(listed.select("source_path", F.col("target_path").alias("new_target")), "source_path")
    todo = todo.withColumn("target_path", F.coalesce("known_target", "new_target")).join(texts, "source_path")
    owned = index.select("target_path", F.col("source_path").alias("owner"))
    todo = todo.join(owned, "target_path", "left")
    rows = todo.withColumn("source", F.col("content")).withColumn("target", F.when(F.col("result") == changes.CONTENT, _targets(kb_dir)("target_path")))
    if patch_fields:
        rows = rows.withColumn("patch_fields", F.array(*(F.lit(f) for f in patch_fields)))
    applied = changes.apply_strategies(rows.withColumnRenamed("result", "detected"), forced).withColumnRenamed("result", "text").withColumnRenamed("detected", "result")
    invalid = validated(strict)("source")
    taken = (F.col("result") == changes.NEW) & F.col("owner").isNotNull() & (F.col("owner") != F.col("source_path"))
    error = F.when(taken, F.concat(F.lit("target is tracked already: "), "target_path")).when((F.col("used") != "skip") | (F.col("result") == changes.NEW), F.nullif(invalid, F.lit("")))
    done = applied.withColumn("error", error).select("source_path", "target_path", "result", "used", "changed", "text", "error", "new_hash", "size", "mtime")
    rest = detected.where(~F.col("result").isin(changes.NEW, changes.CONTENT)).select("source_path", F.col("known_target").alias("target_path"), "result", F.lit(None).cast("string").alias("used"), F.lit(False).alias("changed"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"), "new_hash", "size", "mtime")
    return done.unionByName(rest)


def apply_import(plan: DataFrame, index: DataFrame, kb_dir: str, forced: str = "") -> tuple[dict[str, int], DataFrame]:
    """Write what changed; counts of total, imported, skipped and failed, and the new index."""
    folder = os.path.abspath(kb_dir)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for r in pdf.itertuples(index=False):
                error = r.error
                if error is None and r.changed and r.text is not None:
                    path = os.path.normpath(os.path.join(folder, r.target_path))
                    try:
                        if not path.startswith(folder + os.sep):
                            raise OSError("target leaves the folder")
                        os.makedirs(os.path.dirname(path), exist_ok=True)
                        with open(path + ".part", "w", encoding="utf-8", newline="") as f:
                            f.write(r.text)
                        os.replace(path + ".part", path)
                    except OSError as e:
                        error = str(e)
                errors.append(error)
            yield pdf.drop(columns=["text"]).assign(error=errors)

    schema = "source_path string, target_path string, result string, used string, changed boolean, error string, new_hash string, size long, mtime timestamp"
    done = written(plan.select("source_path", "target_path", "result", "used", "changed", "text", "error", "new_hash", "size", "mtime").mapInPandas(write, schema), "imported")
    ok = done.where("error is null")
    fresh = written(changes.updated_index(index, ok, F.current_timestamp(), F.col("target_path"), forced).where("target_path is not null"), "index")
    failed = F.col("error").isNotNull()
    row = done.agg(F.count("*").alias("total"), F.sum(F.when(~failed & F.col("changed"), 1).otherwise(0)).alias("imported"), F.sum(F.when(~failed & ~F.col("changed"), 1).otherwise(0)).alias("skipped"), F.sum(F.when(failed, 1).otherwise(0)).alias("failed")).first()
    return {k: int(v or 0) for k, v in row.asDict().items()}, fresh


def present_sources(index: DataFrame) -> DataFrame:
    """Size and time of each tracked source that is there and no entry of an archive; the executors look them up."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, target in zip(pdf["source_path"], pdf["target_path"], strict=True):
                try:
                    s = os.stat(source)
                except OSError:
                    continue
                out.append((source, target, s.st_size, dt.datetime.fromtimestamp(s.st_mtime, dt.UTC), source))
            yield pd.DataFrame(out, columns=["source_path", "target_path", "size", "mtime", "file"]).astype({"mtime": "datetime64[us, UTC]"})

    return index.where(~F.col("source_path").contains("::")).select("source_path", "target_path").mapInPandas(look, SOURCES)


def sync(spark: SparkSession, index: DataFrame, kb_dir: str, forced: str = "", prune: bool = False) -> tuple[dict[str, int], DataFrame]:
    """Import every tracked source again; with ``prune`` forget those that are gone, but not entries of archives."""
    listed = present_sources(index)
    files = index.where(~F.col("source_path").contains("::"))
    plan = plan_import(listed, files, kb_dir, forced)
    counts, fresh = apply_import(plan, files, kb_dir, forced)
    if prune:
        fresh = changes.prune_missing(fresh, plan)
    return counts, fresh.unionByName(index.where(F.col("source_path").contains("::")))


def rebuild_index(spark: SparkSession, kb_dir: str) -> DataFrame:
    """An index of a folder as it is: every document its own source, strategy skip."""
    folder = os.path.abspath(kb_dir)
    rows = [(os.path.join(folder, p), p, s, dt.datetime.fromtimestamp(m, dt.UTC), os.path.join(folder, p)) for p, s, m in list_files(folder)]
    listed = spark.createDataFrame(rows, SOURCES)
    hashed = read_texts(listed).select("source_path", F.sha2("content", 256).alias("content_hash"))
    return listed.join(hashed, "source_path").select("source_path", "target_path", "content_hash", F.col("mtime").alias("last_modified"), F.current_timestamp().alias("last_imported"), F.col("size").alias("file_size"), F.lit("skip").alias("strategy"), F.array().cast("array<string>").alias("patch_fields"), F.lit(True).alias("source_exists"))


def clean_index(index: DataFrame, kb_dir: str) -> DataFrame:
    """The index without rows whose source or target is gone."""
    folder = os.path.abspath(kb_dir)

    def check(sources: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([os.path.exists(s.partition("::")[0]) and os.path.exists(os.path.join(folder, t)) for s, t in zip(sources, targets, strict=True)], dtype=bool)

    return index.where(F.pandas_udf(check, "boolean")("source_path", "target_path"))
