"""The service: knowledge paths, freshness, ranked queries and context packs in one stable JSON envelope."""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions.session import written
from marrow.operators import bundle, changes, codegraph, context, predicates, rank
from marrow.sources import git, markdown, state

SCHEMA = "kb.tool.v1"
#: Failures that an error's text names; it tells how many there are and where all of them stand.
SHOWN = 20
FILTERS = ("type", "tag", "path", "language", "symbol_kind", "qualified_name", "relation_kind", "relation_source", "relation_target")
# Criteria of the query that narrow candidates for each exact filter.
_CRITERIA = {"language": "code_language", "symbol_kind": "code_symbol_kind", "qualified_name": "code_qualified_name", "relation_kind": "code_relation_kind", "relation_source": "code_relation_source", "relation_target": "code_relation_target"}


class ServiceError(Exception):
    def __init__(self, code: str, message: str, remediation: str = ""):
        super().__init__(message)
        self.code, self.message, self.remediation = code, message, remediation


@dataclass
class Service:
    spark: SparkSession
    repo: str = ""
    directory: str = ""
    settings: state.Settings | None = None

    def paths(self) -> list[state.KnowledgePath]:
        return state.resolve_paths(self.settings or state.Settings(), self.directory, os.environ.get("MARROW_KNOWLEDGE_DIR", ""), self.repo, os.getcwd())

    def freshness(self) -> dict[str, Any] | None:
        if not self.repo:
            return None
        try:
            head = git.head(self.repo)
        except (subprocess.CalledProcessError, OSError):
            return None
        last = (state.read_state(self.paths()[0].path) or {}).get("last_indexed_commit", "")
        return {"head": head, "last_indexed_commit": last, "stale": head != last}

    def load(self) -> tuple[DataFrame, list[str]]:
        """All bundles with their ranks, generated duplicates collapsed; a missing overlay is a warning, a missing first path an error."""
        parts, warnings = [], []
        for p in self.paths():
            if not os.path.isdir(p.path):
                if p.rank == 0:
                    raise ServiceError("knowledge_not_initialized", f"no knowledge at {p.path}", "run init first")
                warnings.append(f"knowledge path missing: {p.path}")
                continue
            concepts, _ = markdown.load_bundle(self.spark, p.path)
            more = F.map_concat(F.coalesce("custom", F.create_map().cast("map<string,string>")), F.create_map(F.lit("knowledge_path"), F.lit(p.path), F.lit("knowledge_path_source"), F.lit(p.source)))
            parts.append(concepts.withColumn("custom", more))
        return bundle.collapse_overlays(bundle.overlay(*parts)), warnings

    def envelope(self, operation: str, run, mutating: bool = False) -> dict[str, Any]:  # noqa: ANN001
        out: dict[str, Any] = {"schema_version": SCHEMA, "operation": operation, "ok": True, "mutating": mutating, "repo_root": self.repo, "knowledge_dir": self.paths()[0].path, "freshness": self.freshness(), "warnings": []}
        try:
            out["result"], out["warnings"] = run()
        except ServiceError as e:
            out |= {"ok": False, "error": {"code": e.code, "message": e.message, "remediation": e.remediation}}
        except Exception as e:  # noqa: BLE001  the contract: every failure is an envelope
            out |= {"ok": False, "error": {"code": "internal_error", "message": str(e)}}
        return {k: v for k, v in out.items() if v is not None}

    def status(self) -> dict[str, Any]:
        def run() -> tuple[dict, list[str]]:
            where = self.paths()
            ready = os.path.isdir(where[0].path)
            n = self.load()[0].count() if ready else 0
            return {"initialized": ready, "concepts": n, "read_paths": [vars(p) for p in where]}, []

        return self.envelope("status", run)

    def query(self, text: str = "", limit: int = 10, explain: bool = False, **filters: str) -> dict[str, Any]:
        def run() -> tuple[dict, list[str]]:
            if limit < 0:
                raise ServiceError("invalid_query", "limit must not be negative")
            if unknown := set(filters) - set(FILTERS):
                raise ServiceError("invalid_query", f"no such filter: {', '.join(sorted(unknown))}")
            if not text.strip() and not any(filters.values()):
                raise ServiceError("invalid_query", "a query needs a text or a filter")
            concepts, warnings = self.load()
            wide = predicates.Query(**{_CRITERIA[k]: v for k, v in filters.items() if v and k in _CRITERIA}).predicate()
            where = wide & predicates.exact_filter(**filters)
            hits = rank.ranked(concepts, text, limit, where)
            rows = [r.asDict() for r in hits.drop("ord", "exactness", "type_rank").orderBy("rank").toLocalIterator()]
            result: dict[str, Any] = {"query": text, "hits": rows, "count": len(rows)}
            if explain:
                result["trace"] = rank.trace(concepts, text, limit, filters, [p.path for p in self.paths()], where, [r["location"] or r["concept_path"] for r in rows])
            return result, warnings

        return self.envelope("query", run)

    def context(self, text: str, budget: int = 0, relations: bool = False) -> dict[str, Any]:
        def run() -> tuple[dict, list[str]]:
            if not text.strip():
                raise ServiceError("invalid_query", "a context needs a query")
            concepts, warnings = self.load()
            best = rank.best_of_each(rank.many(concepts, [(0, text)]), context.MOST_CANDIDATES)
            rows = [r.asDict() for r in best.orderBy("rank").collect()]  # at most MOST_CANDIDATES
            near = [r.asDict() for r in context.neighbours(best, concepts).orderBy("rank", "slot").collect()] if relations else []
            make = lambda r, rel: context.Candidate(r["source_path"], r["start_line"], r["end_line"], [r], r["reason"] if rel else "", rel)
            paths = [p.path for p in self.paths()]
            collapsed = concepts.agg(F.coalesce(F.sum(F.size("duplicate_sources")), F.lit(0))).first()[0]
            trace = [rank.step("path_resolution", paths, read_paths=len(paths)), rank.step("primary_hits", [r["location"] or r["concept_path"] for r in rows], hits=len(rows)), rank.step("overlay_merge", collapsed_duplicates=collapsed)]
            by_rank: dict[int, list] = {}
            for r in near:
                by_rank.setdefault(r["rank"] - 1, []).append(make(r, True))
            candidates = context.expand([make(r, False) for r in rows], by_rank, trace if relations else None)
            if not relations:
                trace.append({"type": "relation_expansion", "message": context.NO_EXPANSION, "counts": {"neighbors": 0}})
            packed = context.pack(candidates, self._sources({c.path for c in candidates}), text, budget)
            return {"query": text, "budget_tokens": budget if budget > 0 else context.DEFAULT_BUDGET, "used_tokens": packed.used, "omitted": packed.omitted, "omitted_lines": packed.omitted_lines, "items": packed.items, "omissions": packed.omissions, "trace": trace + packed.trace}, warnings + packed.warnings

        return self.envelope("context", run)

    def _sources(self, paths: set[str]) -> dict[str, str]:
        base, out = os.path.realpath(self.repo or os.getcwd()), {}
        for p in paths:
            full = os.path.realpath(os.path.join(base, p))
            if p and context.safe(p) and full.startswith(base + os.sep) and os.path.isfile(full):
                with open(full, "rb") as f:
                    out[p] = f.read(context.SOURCE_BYTES).decode("utf-8", "replace")
        return out

    def generate(self, full: bool = True) -> dict[str, Any]:
        """Analyse the repository (or what changed since the checkpoint), write its concepts, then the checkpoint."""

        def run() -> tuple[dict, list[str]]:
            where, head = self.paths()[0].path, git.head(self.repo)
            last = (state.read_state(where) or {}).get("last_indexed_commit", "")
            if not full and last == head:
                return {"mode": "unchanged", "concepts": 0}, []
            files = git.file_table(self.spark, self.repo)
            meta = codegraph.commit_metadata(git.change_log(self.spark, self.repo))
            summaries = codegraph.summaries(files).join(files.select("path", "modified_at"), "path", "left").join(meta, "path", "left")
            concepts = codegraph.concepts_of(summaries).withColumn("ord", F.lit(0))
            removed = 0
            if not full and last:
                # what git tells to have changed since is as long as that difference, and is joined, not listed in the plan
                changed = self.spark.createDataFrame([(p,) for p in git.changed_files(self.repo, last, head)], "path string")
                gone = changes.tombstones(changed, files).where("deleted").select(F.concat("path", F.when(F.col("path").endswith(".md"), "").otherwise(".md")).alias("save_path"))
                removed = markdown.remove_files(gone, where)
                concepts = concepts.join(changed.distinct(), F.col("file_path") == F.col("path"), "left_semi")
            saved = markdown.save_bundle(concepts, where, generated=True)
            failed = saved.where("error is not null")
            if n := failed.count():
                some = "; ".join(f"{r['save_path']}: {r['error']}" for r in failed.orderBy("save_path").limit(SHOWN).collect())
                raise ServiceError("save_failed", f"{n} files could not be written, the first of them: {some}", f"all are listed in {written(failed.coalesce(1), 'save-errors').inputFiles()[0]}")
            state.write_state(where, head)
            return {"mode": "full" if full or not last else "incremental", "concepts": saved.count(), "removed": removed}, []

        return self.envelope("init" if full else "refresh", run, mutating=True)


def to_json(envelope: dict[str, Any]) -> str:
    return json.dumps(envelope, ensure_ascii=False, indent=2, default=str)


def exit_code(envelope: dict[str, Any]) -> int:
    return 0 if envelope["ok"] else 1
