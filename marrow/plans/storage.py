"""Queries that write and read what lies outside tables: bundles, archives, indexes, settings, repositories, watched folders.

Each makes its own folder in the shared folder of the session, from whole tables, and reads back what it wrote.
"""

from __future__ import annotations

import os
import subprocess
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow import importing
from marrow.functions.session import own_dir
from marrow.functions.text import nz
from marrow.operators import changes, lint, rank
from marrow.operators.predicates import Query
from marrow.plans.knowledge import _C, _LINT, _hits
from marrow.plans.pipeline import _DETECT, _FILES, _listing, files
from marrow.plans.tables import KB, concepts, once, table
from marrow.service import Service
from marrow.sources import archives, git, hooks, markdown, state
from marrow.streaming import watch


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors see as a path."""
    path = f"{own_dir(spark).removeprefix('file://')}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


# --- bundles --------------------------------------------------------------------------------------------------------


def _bundle(spark: SparkSession, sf_dir: str) -> str:
    """All concepts saved as documents, in seven folders."""
    c = once(concepts(spark, sf_dir)).drop("custom", "repository_id").withColumn("type", nz("type"))
    root = folder(spark, "bundle")
    saved = markdown.save_bundle(c.withColumn("file_path", F.concat((F.col("ord") % 7).cast("string"), F.lit("/c"), F.col("ord").cast("string"), F.lit(".md"))), root)
    assert saved.where("error is not null").isEmpty()
    return root


def bundle_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every concept after it was saved and loaded again."""
    got, _ = markdown.load_bundle(spark, _bundle(spark, sf_dir))
    return got.select("file_path", "type", "title", "description", "resource", F.array_join("tags", "|").alias("tags"), "timestamp", F.md5("content").alias("content_md5"))


def bundle_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.load_bundle(spark, _bundle(spark, sf_dir))[1]


def files_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found in hidden folders and under endings of either case, and without them."""
    o = F.col("ord").cast("string")
    c = once(concepts(spark, sf_dir).select("ord")).select("ord", F.lit("note").alias("type"), F.lit("T").alias("title"), F.concat(F.when(F.col("ord") % 5 == 0, ".old/").otherwise("new/"), o, F.when(F.col("ord") % 3 == 0, ".MD").otherwise(".md")).alias("file_path"))
    root = folder(spark, "files")
    markdown.save_bundle(c, root)
    rows = [("plain", p) for p, *_ in markdown.list_files(root)] + [("all", p) for p, *_ in markdown.list_files(root, any_case=True, hidden=True)]
    return spark.createDataFrame(rows, "how string, path string")


def _simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = once(concepts(spark, sf_dir).select("ord"))
    o = F.col("ord").cast("string")
    return c.select("ord", F.lit("metric").alias("type"), F.concat(F.lit("No. "), o).alias("title"), F.when(F.col("ord") % 2 == 0, F.concat(F.lit("about "), o)).otherwise("").alias("description"), F.lit("").alias("resource"), F.when(F.col("ord") % 3 == 0, F.array(F.lit("a"), F.concat(F.lit("b"), o))).otherwise(F.array().cast("array<string>")).alias("tags"), F.lit("").alias("timestamp"), F.create_map(F.lit("owner"), F.concat(F.lit("team "), o)).alias("custom"), F.concat(F.lit("Body "), o).alias("content"), F.concat(F.lit("c"), o, F.lit(".md")).alias("file_path"))


def documents_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts as documents."""
    return markdown.render_texts(_simple(spark, sf_dir)).select("file_path", "text")


def documents_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict and the lenient test of texts with and without frontmatter, type and closing fence."""
    c = once(concepts(spark, sf_dir).select("ord"))
    o, k = F.col("ord").cast("string"), F.col("ord") % 5
    text = F.when(k == 0, F.concat(F.lit("Plain "), o)).when(k == 1, F.concat(F.lit("---\ntitle: "), o, F.lit("\n---\nBody\n"))).when(k == 2, F.concat(F.lit("---\ntype: a\ntitle: "), o, F.lit("\nBody\n"))).when(k == 3, F.lit("")).otherwise(F.concat(F.lit("---\r\ntype: a\r\ntitle: '"), o, F.lit("'\r\n---\r\nBody\r\n")))
    texts = c.select("ord", text.alias("text"))
    return texts.select("ord", importing.validated(True)("text").alias("strict"), importing.validated(False)("text").alias("lenient"))


def archive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive per repository, with the concepts that have one; one that holds an unsafe entry is refused as a whole."""
    root = folder(spark, "archives")
    c = once(concepts(spark, sf_dir).select("ord", "repository_id")).where("repository_id <> ''")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        name = group["repository_id"].iloc[0]
        with zipfile.ZipFile(f"{root}/{name}.zip", "w") as z:
            for o in sorted(group["ord"]):
                z.writestr(f"d/./c{o}.md", f"Body {o}")
                z.writestr(f"d/c{o}.txt", "no document")
            if name.startswith("a"):
                z.writestr("../out.md", "")
        return pd.DataFrame({"archive": [f"{root}/{name}.zip"]})

    made = c.groupBy("repository_id").applyInPandas(pack, "archive string").collect()  # a row per repository, whose table is of fixed size
    got = archives.load_archives(spark, [r[0] for r in made])
    base = F.regexp_extract("archive", r"([^/]+)\.zip$", 1)
    return got.select(base.alias("archive"), nz("file_path").alias("file_path"), F.regexp_replace(nz("source_path"), "^.*/", "").alias("entry"), nz("text").alias("text"), nz("error").alias("error"))


# --- indexes and imports --------------------------------------------------------------------------------------------


def index_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file index written as JSON and read again."""
    path = f"{folder(spark, 'index')}/index.json"
    state.save_index(_listing(spark, sf_dir)[2], path)
    return state.load_index(spark, path).select("source_path", "target_path", "content_hash", F.unix_micros("last_modified").alias("modified"), "file_size", "strategy", F.size("patch_fields").alias("n_fields"), "source_exists")


def index_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index whose rows do not say whether their sources exist, and the time of its last import."""
    old = _listing(spark, sf_dir)[2].withColumn("source_exists", F.when(F.col("source_path").endswith("1"), False))
    fixed, last = changes.migrate_index(old)
    return fixed.agg(F.count(F.when(F.col("source_exists"), 1)).alias("n_existing"), F.count(F.when(~F.col("source_exists"), 1)).alias("n_gone"), F.unix_micros(last).alias("last_imported"))


def index_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added to, replaced in and deleted from an index."""
    index = _listing(spark, sf_dir)[2]
    ends = lambda *d: F.substring("source_path", -1, 1).isin(*d)
    first = index.where(~ends("1", "2")).withColumn("strategy", F.lit("kept"))
    more = changes.add_to_index(first, index.where(ends("1", "2")).withColumn("strategy", F.lit("added")))
    other = changes.replace_in_index(more, index.where(ends("3")).withColumn("strategy", F.lit("replaced")))
    return changes.delete_from_index(other, index.where(ends("4"))).select("source_path", "strategy")


def _sources(spark: SparkSession, sf_dir: str) -> str:
    root = folder(spark, "sources")
    markdown.save_bundle(_simple(spark, sf_dir), root)
    return root


def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an import, of the same again, of one after a part was rewritten, and of a sync after a part was removed."""
    src, kb = _sources(spark, sf_dir), folder(spark, "kb")
    empty = spark.createDataFrame([], changes.INDEX)
    rows = []

    def run(name: str, index: DataFrame) -> DataFrame:
        counts, fresh = importing.apply_import(importing.plan_import(importing.list_sources(spark, [src]), index, kb), index, kb)
        rows.append((name, counts["total"], counts["imported"], counts["skipped"], counts["failed"], fresh.count()))
        return fresh

    index = run("again", run("first", empty))
    simple = _simple(spark, sf_dir)
    markdown.save_bundle(simple.where("ord % 4 = 0").withColumn("content", F.lit("rewritten, and longer than it was before")), src)
    index = run("rewritten", index.withColumn("strategy", F.lit("overwrite")))
    markdown.remove_files(simple.where("ord % 10 = 0").select(F.col("file_path").alias("save_path")), src)
    counts, fresh = importing.sync(spark, index, kb, prune=True)
    rows.append(("sync", counts["total"], counts["imported"], counts["skipped"], counts["failed"], fresh.count()))
    return spark.createDataFrame(rows, "step string, total long, imported long, skipped long, failed long, tracked long")


def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import would do with each source, without doing it."""
    src, kb = _sources(spark, sf_dir), folder(spark, "kb")
    plan = importing.plan_import(importing.list_sources(spark, [src], keep_dir=True), spark.createDataFrame([], changes.INDEX), kb, strict=True)
    return plan.select(F.regexp_replace("target_path", "^[^/]*/", "").alias("target_path"), "result", "changed", nz("error").alias("error"), "new_hash")


def index_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made of a folder as it is, and cleaned after a part of the folder was removed."""
    src = _sources(spark, sf_dir)
    index = importing.rebuild_index(spark, src)
    markdown.remove_files(_simple(spark, sf_dir).where("ord % 10 = 0").select(F.col("file_path").alias("save_path")), src)
    return importing.clean_index(index, src).select("target_path", "content_hash", "strategy")


# --- settings, gates, traces ----------------------------------------------------------------------------------------


def knowledge_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where knowledge is read from, for settings written and read again, by five ways to say it."""
    path = f"{folder(spark, 'settings')}/settings.yaml"
    state.save_settings(state.Settings("/kb/own", ["/kb/team", "/kb/./team", "", "/kb/own"]), path)
    s = state.load_settings(path)
    bare = state.Settings("", s.knowledge_paths)
    ways = [("cli", s, {"cli": "/kb/cli"}), ("env", s, {"env": "/kb/env"}), ("config", s, {"repo": "/r"}), ("repo", bare, {"repo": "/r", "cwd": "/c"}), ("cwd", bare, {"cwd": "/c"}), ("platform", bare, {"platform": "/p"}), ("missing", state.load_settings(path + ".none"), {"platform": "/p"})]
    return spark.createDataFrame([(way, p.rank, p.path, p.source) for way, given, kw in ways for p in state.resolve_paths(given, **kw)], "way string, place int, path string, source string")


def watch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch rules read from YAML, with their defaults."""
    root = folder(spark, "rules")
    with open(f"{root}/.watch.yaml", "w", encoding="utf-8") as f:
        f.write("version: 1\ndebounce: 1.5s\nknowledgeDir: /kb\nrules:\n- sources: [/a, /b/../c]\n- {name: docs, sources: [/d], strategy: patch, patterns: ['*.md', '**/*.txt'], debounce: 1m2s, patchFields: [owner]}\n")
    c = state.load_watch_config(root)
    return spark.createDataFrame([(r.name, "|".join(r.sources), r.strategy, "|".join(r.patterns), r.debounce_ms, "|".join(r.patch_fields), c.knowledge_dir) for r in c.rules], "name string, sources string, strategy string, patterns string, debounce_ms int, fields string, kb string")


def checkpoint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit that was indexed last, after the number of source files was written as one."""
    kb = f"{folder(spark, 'state')}/knowledge"
    before = state.read_state(kb)
    state.write_state(kb, str(table(spark, sf_dir, "source_files").count()))
    after = state.read_state(kb)
    return spark.createDataFrame([(before is None, after["schema_version"], after["last_indexed_commit"])], "absent boolean, schema_version int, last_commit string")


def lint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each type of concept passes the gate, and the strict one."""
    c = concepts(spark, sf_dir).withColumn("type", nz("type"))
    issues = lint.lint(c).join(once(c.select("ord", "type")), "ord")
    rows = [(t, lint.passes(mine), lint.passes(mine, strict=True)) for t in ("guide", "metric", "") for mine in [issues.where(F.col("type") == t)]]
    return spark.createDataFrame([*rows, ("no such type", lint.passes(issues.limit(0)), lint.passes(issues.limit(0), strict=True))], "type string, passes boolean, strict boolean")


def query_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of a ranked query with their counts."""
    c = once(concepts(spark, sf_dir))
    steps = rank.trace(c, "registry", 10, {"type": "", "tag": "code"}, ["/kb", "/overlay"])
    return spark.createDataFrame([(k, s["type"], s["message"], next(iter(s["counts"].values())), s.get("score_delta", 0), "|".join(s.get("refs", []))) for k, s in enumerate(steps)], "step int, type string, message string, n long, score_delta long, refs string")


def active_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many criteria of a query are active, and how many concepts they leave."""
    c = once(concepts(spark, sf_dir))
    asked = [("none", Query()), ("one", Query(type="guide")), ("three", Query(type="code_file").with_(tags=("code",), resource="code://"))]
    parts = [q.execute(c).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(q.active()).alias("active"), "n") for name, q in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def service_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of a status and of a failed query."""
    s = Service(spark, directory=_bundle(spark, sf_dir))
    good, bad = s.status(), s.query(limit=-1)
    return spark.createDataFrame([(e["operation"], e["schema_version"], e["ok"], e["mutating"], e.get("result", {}).get("concepts", 0), e.get("error", {}).get("code", "")) for e in (good, bad)], "operation string, schema_version string, ok boolean, mutating boolean, concepts long, error string")


# --- watching -------------------------------------------------------------------------------------------------------


def watch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each source file would come to lie, by a rule over two folders and one file."""
    f = files(spark, sf_dir).select("source_id", F.concat(F.lit("/repo/"), "path").alias("path"))
    one = f.agg(F.min("path")).first()[0]
    config = state.watch_config({"rules": [{"sources": ["/repo/harbor/", one, "/repo"]}]}, "/")
    return f.select("source_id", watch.target_column(config, F.col("path"), F.lit(0)).alias("target"))


def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, sf_dir)
    path = F.concat(F.lit("/r/"), F.col("source_id").cast("string"))
    size = F.coalesce("size", F.lit(0).cast("long"))
    i = F.col("source_id")
    before = f.select(path.alias("path"), size.alias("size"), F.col("modified_at").alias("mtime"))
    after = f.where(i % 5 != 0).select(F.when(i % 11 == 0, F.concat(path, F.lit("-moved"))).otherwise(path).alias("path"), (size + F.when(i % 7 == 0, 1).otherwise(0)).alias("size"), F.col("modified_at").alias("mtime"))
    return before, after


def listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written, removed and renamed between two listings."""
    return watch.listing_events(*_listings(spark, sf_dir)).select("path", "op", nz("renamed_to").alias("renamed_to"))


def watch_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a watched folder hands to the import of their rule."""
    src, out = _sources(spark, sf_dir), folder(spark, "watched")
    config = state.watch_config({"rules": [{"sources": [src], "patterns": ["c*1.md", "c*2.md"]}]}, "/")
    query = watch.start(watch.file_events(spark, f"file://{src}"), config, lambda df, epoch: df.write.mode("overwrite").parquet(f"file://{out}/batch={epoch}"), f"file://{folder(spark, 'checkpoint')}", availableNow=True)
    query.awaitTermination()
    return spark.read.schema("target string, op string, rule int, batch int").parquet(f"file://{out}").select("target", "op", "rule")


# --- version control ------------------------------------------------------------------------------------------------


def _repository(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """A repository of three commits made of all source files' ids: added, a third modified, a fifth deleted and a seventh renamed."""
    ids = sorted(r[0] for r in table(spark, sf_dir, "source_files").select("source_id").collect())  # a repository lies on one machine
    repo = folder(spark, "repo")
    git_ = lambda *a, **kw: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True, **kw)
    git_("init", "-q")
    line = lambda k, t: f"file {k} of the repository\n" * 5 + t
    stream, commits = [], [("ann", [("M", f"s/f{k}.py", line(k, "")) for k in ids]), ("bob", [("M", f"s/f{k}.py", line(k, "more\n")) for k in ids if k % 3 == 0]), ("ann", [("D", f"s/f{k}.py", "") for k in ids if k % 5 == 0] + [("R", f"s/f{k}.py", f"s/moved{k}.py") for k in ids if k % 5 and k % 7 == 0])]
    for n, (author, todo) in enumerate(commits, 1):
        said = f"Commit {n}"
        stream.append(f"commit refs/heads/main\nmark :{n}\ncommitter {author} <{author}@example.org> {1_700_000_000 + n * 86_400} +0000\ndata {len(said)}\n{said}\n" + (f"from :{n - 1}\n" if n > 1 else ""))
        for op, path, text in todo:
            stream.append(f"M 100644 inline {path}\ndata {len(text)}\n{text}\n" if op == "M" else f"D {path}\n" if op == "D" else f"R {path} {text}\n")
        stream.append("\n")
    git_("fast-import", "--quiet", input="".join(stream).encode())
    git_("symbolic-ref", "HEAD", "refs/heads/main")
    git_("reset", "-q", "--hard")
    return repo, git.run(repo, "rev-list", "--reverse", "HEAD").split()


def git_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo, _ = _repository(spark, sf_dir)
    return git.file_table(spark, repo, "demo").select("repository_id", "path", "size")


def git_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo, _ = _repository(spark, sf_dir)
    got = git.commit_table(spark, repo)
    return got.select("author", "email", "subject", F.unix_seconds("at").alias("at"), F.size("added").alias("n_added"), F.size("modified").alias("n_modified"), F.size("deleted").alias("n_deleted"))


def git_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that differ between the second commit and the third."""
    repo, all_ = _repository(spark, sf_dir)
    return spark.createDataFrame([(p,) for p in git.changed_files(repo, all_[1], all_[2])], "path string")


def service_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge of a repository as it was, refreshed to what it is, and once more."""
    repo, all_ = _repository(spark, sf_dir)
    kb = f"{folder(spark, 'project')}/knowledge"
    service = Service(spark, repo, kb)
    git.run(repo, "reset", "-q", "--hard", all_[1])
    got = [service.generate()]
    git.run(repo, "reset", "-q", "--hard", all_[2])
    got += [service.generate(full=False), service.generate(full=False)]
    rows = [(k, e["operation"], e["ok"], e["result"]["mode"], e["result"]["concepts"], e["result"].get("removed", 0)) for k, e in enumerate(got)]
    return spark.createDataFrame([*rows, (3, "files", True, "", len(markdown.list_files(kb)), 0)], "step int, operation string, ok boolean, mode string, concepts long, removed long")


def hooks_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hook installed, installed again, in the way of another one, and removed."""
    repo, rows = folder(spark, "hooked"), []
    git.run(repo, "init", "-q")
    for kind in hooks.HOOKS:
        done = [hooks.install(repo, kind), hooks.install(repo, kind)]
        path = hooks.place(repo, kind)
        able = os.access(path, os.X_OK) and subprocess.run(["sh", "-n", path], check=False).returncode == 0
        with open(path, "w", encoding="utf-8") as f:
            f.write("#!/bin/sh\n")
        try:
            hooks.install(repo, kind)
            kept = False
        except hooks.HookError:
            kept = hooks.installed(repo, kind) == "other"
        rows.append((kind, *done, able, kept, hooks.install(repo, kind, force=True), hooks.uninstall(repo, kind), hooks.uninstall(repo, kind)))
    return spark.createDataFrame(rows, "kind string, first boolean, again boolean, runs boolean, other_kept boolean, forced boolean, removed boolean, removed_again boolean")


def locks_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a file's lock can be had while it is held, and afterwards."""
    path, got = f"{folder(spark, 'locked')}/index.json", []

    def free() -> bool:
        try:
            with state.exclusive(path, wait=False):
                return True
        except BlockingIOError:
            return False

    with state.exclusive(path):
        got.append(("held", free()))
    return spark.createDataFrame([*got, ("released", free())], "moment string, free boolean")


QUERIES = {f.__name__: f for f in (
    hooks_installed, locks_held, bundle_loaded, bundle_rejects, files_collected, documents_rendered, documents_validated, archive_documents, index_saved, index_migrated, index_edited, import_counts, import_plan, index_rebuilt, knowledge_paths, watch_rules, checkpoint_state,
    lint_gate, query_trace, active_filters, service_status, watch_targets, listing_changes, watch_processed, git_tracked, git_commits, git_changed, service_refreshed,
)}

_N = "chr(10)"
_BODY = f"ltrim(content, chr(13) || {_N})"
_LOADED = KB + f", saved AS (SELECT *, (ord % 7) || '/c' || ord || '.md' AS path, CASE WHEN {_BODY} = '' THEN '' WHEN ends_with(content, {_N}) THEN {_BODY} ELSE {_BODY} || {_N} END AS body FROM kb)"
_SIMPLE = KB + f""", simple AS (SELECT ord, 'c' || ord || '.md' AS path, '---' || {_N} || 'type: metric' || {_N} || 'title: No. ' || ord || {_N} || CASE WHEN ord % 2 = 0 THEN 'description: about ' || ord || {_N} ELSE '' END
  || CASE WHEN ord % 3 = 0 THEN 'tags:' || {_N} || '  - a' || {_N} || '  - b' || ord || {_N} ELSE '' END || 'owner: team ' || ord || {_N} || '---' || {_N} || {_N} || 'Body ' || ord || {_N} AS text FROM kb)
"""
_AT = _FILES + ", l AS (SELECT source_id AS i, '/r/' || source_id AS path, coalesce(size, 0) AS size, modified_at AS m FROM f)"
_WEEK = "SELECT source_id AS k FROM source_files"

SQL = {
    "hooks_installed": "SELECT kind, true AS first, false AS again, true AS runs, true AS other_kept, true AS forced, true AS removed, false AS removed_again FROM (VALUES ('post-commit'), ('pre-commit'), ('pre-push')) AS t(kind)",
    "locks_held": "SELECT * FROM (VALUES ('held', false), ('released', true)) AS t(moment, free)",
    "bundle_loaded": _LOADED + " SELECT path AS file_path, type, title, description, resource, array_to_string(tags, '|') AS tags, stamp AS timestamp, md5(body) AS content_md5 FROM saved WHERE type <> '' AND title <> ''",
    "bundle_rejects": _LOADED + " SELECT path AS file_path, CASE WHEN title = '' THEN 'missing title' ELSE 'missing type' END AS error FROM saved WHERE type = '' OR title = ''",
    "files_collected": KB + ", p AS (SELECT ord, CASE WHEN ord % 5 = 0 THEN '.old/' ELSE 'new/' END || ord || CASE WHEN ord % 3 = 0 THEN '.MD' ELSE '.md' END AS path FROM kb) SELECT 'all' AS how, path FROM p UNION ALL SELECT 'plain', path FROM p WHERE ord % 5 <> 0 AND ord % 3 <> 0",
    "documents_rendered": _SIMPLE + "SELECT path AS file_path, text FROM simple",
    "documents_validated": KB + "SELECT ord, CASE ord % 5 WHEN 3 THEN 'empty document' WHEN 4 THEN '' ELSE 'missing type' END AS strict, CASE WHEN ord % 5 = 2 THEN 'unterminated frontmatter' ELSE '' END AS lenient FROM kb",
    "archive_documents": KB + """, r AS (SELECT *, starts_with(repository_id, 'a') AS bad FROM kb WHERE repository_id <> '')
SELECT repository_id AS archive, 'd/c' || ord || '.md' AS file_path, 'c' || ord || '.md' AS entry, 'Body ' || ord AS text, '' AS error FROM r WHERE NOT bad
UNION ALL SELECT DISTINCT repository_id, '', '', '', 'path traversal entry rejected: ../out.md' FROM r WHERE bad""",
    "index_saved": _DETECT + "SELECT source_path, 'kb/' || source_path AS target_path, h AS content_hash, epoch_us(m) AS modified, n AS file_size, strategy, 0 AS n_fields, true AS source_exists FROM idx",
    "index_migrated": _DETECT + "SELECT count(*) FILTER (NOT ends_with(source_path, '1')) AS n_existing, count(*) FILTER (ends_with(source_path, '1')) AS n_gone, (SELECT max(epoch_us(modified_at)) FROM f WHERE NOT starts_with(repository_id, 'b')) AS last_imported FROM idx",
    "index_edited": _DETECT + "SELECT source_path, CASE right(source_path, 1) WHEN '1' THEN 'added' WHEN '2' THEN 'added' WHEN '3' THEN 'replaced' ELSE 'kept' END AS strategy FROM idx WHERE right(source_path, 1) <> '4'",
    "import_counts": KB + """, n AS (SELECT count(*) AS n, count(*) FILTER (ord % 4 = 0) AS q, count(*) FILTER (ord % 10 = 0) AS t FROM kb)
SELECT 'first' AS step, n AS total, n AS imported, 0 AS skipped, 0 AS failed, n AS tracked FROM n UNION ALL SELECT 'again', n, 0, n, 0, n FROM n UNION ALL SELECT 'rewritten', n, q, n - q, 0, n FROM n UNION ALL SELECT 'sync', n, 0, n, 0, n - t FROM n""",
    "import_plan": _SIMPLE + "SELECT path AS target_path, 'new_file' AS result, true AS changed, '' AS error, sha256(text) AS new_hash FROM simple",
    "index_rebuilt": _SIMPLE + "SELECT path AS target_path, sha256(text) AS content_hash, 'skip' AS strategy FROM simple WHERE ord % 10 <> 0",
    "knowledge_paths": "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {k}, '{p}', '{s}')" for w, rows in {
        "cli": [("/kb/cli", "cli"), ("/kb/team", "overlay"), ("/kb/own", "overlay")], "env": [("/kb/env", "env"), ("/kb/team", "overlay"), ("/kb/own", "overlay")], "config": [("/kb/own", "config"), ("/kb/team", "overlay")],
        "repo": [("/r/.kb/knowledge", "repo_local"), ("/kb/team", "overlay"), ("/kb/own", "overlay")], "cwd": [("/c/.kb/knowledge", "cwd_local"), ("/kb/team", "overlay"), ("/kb/own", "overlay")],
        "platform": [("/p", "platform_default"), ("/kb/team", "overlay"), ("/kb/own", "overlay")], "missing": [("/p", "platform_default")],
    }.items() for k, (p, s) in enumerate(rows)) + ") AS t(way, place, path, source)",
    "watch_rules": "SELECT * FROM (VALUES ('rule-1', '/a|/c', 'merge', '**/*.md', 1500, '', '/kb'), ('docs', '/d', 'patch', '*.md|**/*.txt', 62000, 'owner', '/kb')) AS t(name, sources, strategy, patterns, debounce_ms, fields, kb)",
    "checkpoint_state": "SELECT true AS absent, 1 AS schema_version, count(*)::VARCHAR AS last_commit FROM source_files",
    "lint_gate": _LINT + ", t AS (SELECT kb.type, issue.severity FROM issue JOIN kb USING (ord)) SELECT n.type, count(*) FILTER (severity = 'ERROR') = 0 AS passes, count(*) FILTER (severity IN ('ERROR', 'WARN')) = 0 AS strict FROM (VALUES ('guide'), ('metric'), (''), ('no such type')) AS n(type) LEFT JOIN t ON t.type = n.type GROUP BY n.type",
    "query_trace": KB + f""", h AS ({_hits("'registry'")}), s AS (SELECT count(*) AS loaded, count(*) FILTER (score > 0) AS matches, coalesce(max(score), 0) AS top FROM h)
SELECT 0 AS step, 'path_resolution' AS type, 'resolved knowledge paths' AS message, 2 AS n, 0 AS score_delta, '/kb|/overlay' AS refs UNION ALL SELECT 1, 'bundle_load', 'loaded knowledge bundle', loaded, 0, '' FROM s
UNION ALL SELECT 2, 'overlay_merge', 'no overlay merges applied', 0, 0, '' UNION ALL SELECT 3, 'filter_application', 'applied structured query filters', 1, 0, '' UNION ALL SELECT 4, 'candidate_scoring', 'scored matching candidates', matches, top, '' FROM s
UNION ALL SELECT 5, 'ranking', 'ordered candidates by deterministic tie-breaks', least(10, matches), 0, '' FROM s""",
    "active_filters": KB + "SELECT 'none' AS name, 0 AS active, count(*) AS n FROM kb UNION ALL SELECT 'one', 1, count(*) FROM kb WHERE type = 'guide' UNION ALL SELECT 'three', 3, count(*) FROM kb WHERE type = 'code_file' AND list_contains(tags, 'code') AND contains(lower(resource), 'code://')",
    "service_status": KB + "SELECT 'status' AS operation, 'kb.tool.v1' AS schema_version, true AS ok, false AS mutating, count(*) AS concepts, '' AS error FROM kb WHERE type <> '' AND title <> '' UNION ALL SELECT 'query', 'kb.tool.v1', false, false, 0, 'invalid_query'",
    "watch_targets": _FILES + " SELECT source_id, CASE WHEN starts_with(path, 'harbor/') THEN substr(path, 8) WHEN path = (SELECT min(path) FROM f) THEN regexp_extract(path, '[^/]*$') ELSE path END AS target FROM f",
    "listing_changes": _AT + """, a AS (SELECT CASE WHEN i % 11 = 0 THEN path || '-moved' ELSE path END AS path, size + CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END AS size, m FROM l WHERE i % 5 <> 0),
e AS (SELECT coalesce(l.path, a.path) AS path, CASE WHEN l.path IS NULL THEN 'create' WHEN a.path IS NULL THEN 'remove' ELSE 'write' END AS op, coalesce(a.size, l.size) AS size, coalesce(a.m, l.m) AS m
  FROM l FULL JOIN a ON l.path = a.path WHERE l.path IS NULL OR a.path IS NULL OR l.size <> a.size),
k AS (SELECT *, row_number() OVER (PARTITION BY op, size, m ORDER BY path) AS k FROM e)
SELECT r.path, CASE WHEN c.path IS NULL THEN r.op ELSE 'rename' END AS op, coalesce(c.path, '') AS renamed_to FROM k r LEFT JOIN k c ON r.op = 'remove' AND c.op = 'create' AND r.size = c.size AND r.m = c.m AND r.k = c.k""",
    "watch_processed": KB + "SELECT 'c' || ord || '.md' AS target, 'create' AS op, 0 AS rule FROM kb WHERE right(ord::VARCHAR, 1) IN ('1', '2')",
    "git_tracked": f"WITH s AS ({_WEEK}) SELECT 'demo' AS repository_id, CASE WHEN k % 7 = 0 THEN 's/moved' ELSE 's/f' END || k || '.py' AS path, 5 * length('file ' || k || ' of the repository_') + CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END AS size FROM s WHERE k % 5 <> 0",
    "git_commits": f"""WITH s AS ({_WEEK}), n AS (SELECT count(*) AS n, count(*) FILTER (k % 3 = 0) AS m, count(*) FILTER (k % 5 = 0) AS d, count(*) FILTER (k % 5 <> 0 AND k % 7 = 0) AS r FROM s)
SELECT 'ann' AS author, 'ann@example.org' AS email, 'Commit 1' AS subject, 1700086400 AS at, n AS n_added, 0 AS n_modified, 0 AS n_deleted FROM n
UNION ALL SELECT 'bob', 'bob@example.org', 'Commit 2', 1700172800, 0, m, 0 FROM n UNION ALL SELECT 'ann', 'ann@example.org', 'Commit 3', 1700259200, 0, r, d + r FROM n""",
    "git_changed": f"WITH s AS ({_WEEK}) SELECT 's/f' || k || '.py' AS path FROM s WHERE k % 5 = 0 OR k % 7 = 0 UNION ALL SELECT 's/moved' || k || '.py' FROM s WHERE k % 5 <> 0 AND k % 7 = 0",
    "service_refreshed": f"""WITH s AS ({_WEEK}), n AS (SELECT count(*) AS n, count(*) FILTER (k % 5 = 0) AS d, count(*) FILTER (k % 5 <> 0 AND k % 7 = 0) AS r FROM s)
SELECT 0 AS step, 'init' AS operation, true AS ok, 'full' AS mode, n AS concepts, 0 AS removed FROM n UNION ALL SELECT 1, 'refresh', true, 'incremental', r, d + r FROM n
UNION ALL SELECT 2, 'refresh', true, 'unchanged', 0, 0 UNION ALL SELECT 3, 'files', true, '', n - d, 0 FROM n""",
}
