"""Command line: python -m marrow.cli COMMAND ... ; every command prints text, or JSON with --json."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys

from pyspark.sql import SparkSession

from marrow import importing
from marrow.operators import bundle, lint, predicates
from marrow.service import FILTERS, Service, exit_code, to_json
from marrow.sources import hooks, markdown, state

INDEX_FILE = ".index.json"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marrow")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple) -> None:
        c = sub.add_parser(name)
        c.add_argument("--repo", default="")
        c.add_argument("--dir", default="")
        c.add_argument("--json", action="store_true")
        for names, options in flags:
            c.add_argument(*names, **options)

    flag = lambda *n, **o: (n, {"action": "store_true"} | o)
    text = lambda *n, **o: (n, {"default": ""} | o)
    command("init", flag("--force"))
    command("update", flag("--full"))
    command("lint", flag("--strict"), text("--require", help="tags, with commas"))
    command("show")
    command("search", text("-q"), text("--type"), text("--tag"), text("--code-language"), text("--code-path"), text("--code-symbol-kind"), text("--code-qualified-name"), text("--code-relation-kind"))
    command("add", (("paths",), {"nargs": "+"}), text("--strategy"), text("--patch-fields"), flag("--detect-only"), flag("--strict"))
    command("sync", text("--strategy"), flag("--prune"))
    command("metadata", (("action",), {"choices": ["inspect", "rebuild", "clean"]}))
    command("hook", (("--type",), {"default": "post-commit", "choices": list(hooks.HOOKS)}), flag("--uninstall"), flag("--force"))
    command("status")
    command("query", text("-q"), (("--limit",), {"type": int, "default": 10}), flag("--trace"), *(text("--" + f.replace("_", "-")) for f in FILTERS))
    command("context", text("-q"), (("--budget",), {"type": int, "default": 4000}), flag("--relations"))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "hook":
        return _hook(a)
    spark = spark or SparkSession.builder.appName("marrow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    service = Service(spark, a.repo, a.dir)
    where = service.paths()[0].path
    if a.command in ("init", "update", "status", "query", "context"):
        if a.command in ("init", "update"):
            got = service.generate(a.command == "init" or a.full)
        elif a.command == "status":
            got = service.status()
        elif a.command == "query":
            got = service.query(a.q, a.limit, a.trace, **{f: getattr(a, f) for f in FILTERS})
        else:
            got = service.context(a.q, a.budget, a.relations)
        print(to_json(got))
        return exit_code(got)
    if a.command in ("add", "sync", "metadata"):
        with state.exclusive(os.path.join(where, INDEX_FILE)):  # one writer at a time
            return _index_command(spark, a, where)
    concepts, rejects = markdown.load_bundle(spark, where)
    if a.command == "lint":
        issues = lint.lint(concepts, lint.Config(required_tags=tuple(t for t in a.require.split(",") if t)))
        for r in issues.orderBy("ord", "seq").toLocalIterator():
            print(f"{r['file_path']}:{r['line']}: {r['severity']} {r['code']} {r['message']}")
        return 0 if lint.passes(issues, a.strict) else 1
    if a.command == "show":
        s = bundle.stats(concepts).first()
        print(f"{s['n_concepts']} concepts, {s['n_types']} types, {s['n_tags']} tags; {rejects.count()} documents not read")
        return 0
    found = predicates.dispatch_search(concepts, a.q, a.type, a.tag, code_language=a.code_language, code_file_path=a.code_path, code_symbol_kind=a.code_symbol_kind, code_qualified_name=a.code_qualified_name, code_relation_kind=a.code_relation_kind)
    for r in found.select("ord", "type", "title", "file_path").orderBy("ord").toLocalIterator():
        print(f"{r['type']}\t{r['title']}\t{r['file_path']}")
    return 0


def _hook(a: argparse.Namespace) -> int:
    try:
        done = hooks.uninstall(a.repo or ".", a.type) if a.uninstall else hooks.install(a.repo or ".", a.type, a.force)
    except (hooks.HookError, subprocess.CalledProcessError) as e:
        print(e)
        return 1
    print(f"{a.type} hook {'removed' if a.uninstall else 'installed'}" if done else f"{a.type} hook was {'not there' if a.uninstall else 'there already'}")
    return 0


def _index_command(spark: SparkSession, a: argparse.Namespace, where: str) -> int:
    path = os.path.join(where, INDEX_FILE)
    index = state.load_index(spark, path)
    if a.command == "metadata":
        if a.action == "inspect":
            for r in index.orderBy("target_path").toLocalIterator():
                print(f"{r['target_path']}\t{r['source_path']}\t{r['strategy']}\t{r['source_exists']}")
            return 0
        state.save_index(importing.rebuild_index(spark, where) if a.action == "rebuild" else importing.clean_index(index, where), path)
        return 0
    if a.command == "sync":
        counts, fresh = importing.sync(spark, index, where, a.strategy, a.prune)
    else:
        listed = importing.list_sources(spark, a.paths)
        plan = importing.plan_import(listed, index, where, a.strategy, [f for f in a.patch_fields.split(",") if f], a.strict)
        if a.detect_only:
            for r in plan.select("source_path", "target_path", "result").orderBy("source_path").toLocalIterator():
                print(f"{r['result']}\t{r['source_path']}\t{r['target_path'] or ''}")
            return 0
        counts, fresh = importing.apply_import(plan, index, where, a.strategy)
    state.save_index(fresh, path)
    print(", ".join(f"{k} {v}" for k, v in counts.items()))
    return 1 if counts["failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
