"""Small files of state and configuration: checkpoint, file index, settings, watch rules. Read and written on the driver."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.operators.changes import INDEX, STRATEGIES

try:
    import fcntl
except ImportError:  # no such locks on this platform
    fcntl = None
try:
    import yaml
except ImportError:
    yaml = None


def write_atomic(path: str, data: str | Iterable[str]) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.writelines([data] if isinstance(data, str) else data)
    os.replace(part, path)


@contextlib.contextmanager
def exclusive(path: str, wait: bool = True) -> Iterator[None]:
    """Hold a file's lock against other processes of this machine; without ``wait`` a BlockingIOError tells that it is held."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".lock", "a", encoding="utf-8") as f:
        if fcntl is not None:
            fcntl.flock(f, fcntl.LOCK_EX if wait else fcntl.LOCK_EX | fcntl.LOCK_NB)
        yield  # closing the file releases the lock


# --- checkpoint of the last indexed commit ----------------------------------------------------------------------


def read_state(knowledge_dir: str) -> dict | None:
    path = os.path.join(os.path.dirname(os.path.abspath(knowledge_dir)), "state.json")
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_state(knowledge_dir: str, commit: str) -> None:
    state = {"schema_version": 1, "last_indexed_commit": commit, "updated_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds")}
    write_atomic(os.path.join(os.path.dirname(os.path.abspath(knowledge_dir)), "state.json"), json.dumps(state, indent=2))


# --- file index ---------------------------------------------------------------------------------------------------
# Within the engine the index is a table. The JSON form is for exchange with other tools.

# Fixed names of the JSON form, in its order, with the columns of the table.
_NAMES = {
    "sourcePath": "source_path", "targetPath": "target_path", "contentHash": "content_hash", "lastModified": "last_modified", "lastImported": "last_imported",
    "fileSize": "file_size", "strategy": "strategy", "patchFields": "patch_fields", "sourceExists": "source_exists",
}
_JSON = "version string, files map<string, struct<sourcePath: string, targetPath: string, contentHash: string, lastModified: string, lastImported: string, fileSize: bigint, strategy: string, patchFields: array<string>, sourceExists: boolean>>"


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON index as a table; a missing file is an empty one, a corrupt one an error. Spark reads it, not the driver."""
    if not os.path.exists(path):
        return spark.createDataFrame([], INDEX)
    whole = spark.read.schema(_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    m = whole.select(F.explode("files").alias("target", "m")).select("target", "m.*")
    stamp = lambda c: F.when(F.col(c) != "", F.col(c).cast("timestamp"))
    absent = {"lastModified": stamp("lastModified"), "lastImported": stamp("lastImported"), "fileSize": F.coalesce("fileSize", F.lit(0).cast("long")), "patchFields": F.coalesce("patchFields", F.array().cast("array<string>")), "sourceExists": F.coalesce("sourceExists", F.lit(True))}
    absent["targetPath"] = F.coalesce(F.nullif("targetPath", F.lit("")), F.col("target"))
    return m.select(*(absent.get(old, F.coalesce(old, F.lit(""))).alias(new) if old in absent or old in ("sourcePath", "contentHash", "strategy") else F.col(old).alias(new) for old, new in _NAMES.items()))


def save_index(index: DataFrame, path: str) -> None:
    """The index as JSON for other tools, replaced in one step: rows pass through the driver one partition at a time, none is kept."""
    from marrow.functions.session import written

    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    row = F.to_json(F.struct(*((stamp(new) if new.startswith("last_") else F.col(new)).alias(old) for old, new in _NAMES.items())), {"ignoreNullFields": "false"})
    rows = written(index.select("target_path", "source_path", "last_imported", row.alias("row")).sort("target_path"), "index")
    newest = rows.agg(stamp(F.max("last_imported"))).first()[0] or ""

    def parts() -> Iterator[str]:
        yield '{\n  "version": "1.0",\n  "updatedAt": ' + json.dumps(newest) + ',\n  "files": {'
        for k, r in enumerate(rows.select("target_path", "row").toLocalIterator()):
            yield ("," if k else "") + f"\n    {json.dumps(r[0])}: {r[1]}"
        yield '\n  },\n  "bySource": {'
        for k, r in enumerate(rows.select("source_path", "target_path").toLocalIterator()):
            yield ("," if k else "") + f"\n    {json.dumps(r[0])}: {json.dumps(r[1])}"
        yield "\n  }\n}\n"

    write_atomic(path, parts())


# --- settings -----------------------------------------------------------------------------------------------------


@dataclass
class Settings:
    knowledge_dir: str = ""
    knowledge_paths: list[str] = field(default_factory=list)


def load_settings(path: str) -> Settings:
    """Settings of a YAML file; defaults if it is missing or empty."""
    if not os.path.exists(path) or yaml is None:
        return Settings()
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    return Settings(data.get("knowledge_dir") or "", list(data.get("knowledge_paths") or []))


def save_settings(s: Settings, path: str) -> None:
    lines = [f"knowledge_dir: {json.dumps(s.knowledge_dir)}\n", "knowledge_paths:\n" if s.knowledge_paths else "knowledge_paths: []\n"]
    write_atomic(path, "".join(lines + [f"  - {json.dumps(p)}\n" for p in s.knowledge_paths]))


@dataclass(frozen=True)
class KnowledgePath:
    path: str
    source: str
    rank: int


def resolve_paths(settings: Settings, cli: str = "", env: str = "", repo: str = "", cwd: str = "", platform: str = "", local: str = ".kb/knowledge") -> list[KnowledgePath]:
    """Where knowledge is read from, best first: command line, environment, settings, repository, folder, platform; then overlays, each place once."""
    if cli:
        first = (cli, "cli")
    elif env:
        first = (env, "env")
    elif settings.knowledge_dir:
        first = (settings.knowledge_dir, "config")
    elif repo:
        first = (os.path.join(repo, local), "repo_local")
    elif cwd:
        first = (os.path.join(cwd, local), "cwd_local")
    else:
        first = (platform or os.path.join(os.path.expanduser("~"), local), "platform_default")
    out: list[KnowledgePath] = []
    seen: set[str] = set()
    for path, source in [first, *((os.path.normpath(p), "overlay") for p in settings.knowledge_paths if p and os.path.normpath(p) != ".")]:
        key = os.path.realpath(path)
        if key not in seen:
            seen.add(key)
            out.append(KnowledgePath(path, source, len(out)))
    return out


# --- watch rules --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class WatchRule:
    name: str
    sources: tuple[str, ...]
    strategy: str = "merge"
    patterns: tuple[str, ...] = ("**/*.md",)
    debounce_ms: int = 300
    patch_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class WatchConfig:
    rules: tuple[WatchRule, ...]
    knowledge_dir: str = ""
    debounce_ms: int = 300


def duration_ms(v: str | int | float | None) -> int:
    """``500ms``, ``1.5s``, ``2m``, ``1h`` and sums of them; a bare number is nanoseconds."""
    if not v:
        return 0
    if isinstance(v, (int, float)) or re.fullmatch(r"\d+", v):
        return int(float(v) / 1e6)
    unit = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1, "s": 1e3, "m": 6e4, "h": 3.6e6}
    parts = re.findall(r"([\d.]+)(ns|us|µs|ms|s|m|h)", v)
    if "".join(a + b for a, b in parts) != v:
        raise ValueError(f"invalid duration {v!r}")
    return int(sum(float(a) * unit[b] for a, b in parts))


def _faults(data: dict) -> Iterator[str]:
    """What keeps a configuration from being used."""
    if (data.get("version") or 1) != WATCH_VERSION:
        yield f"configurations of version {data['version']} are not understood, only those of {WATCH_VERSION}"
    if not data.get("rules"):
        yield "there is no rule to watch by"
    for r in data.get("rules") or []:
        if not r.get("sources"):
            yield f"{_called(data, r)} names nothing to watch"
        if (r.get("strategy") or DEFAULT_STRATEGY) not in STRATEGIES:
            yield f"{_called(data, r)} wants to merge by {r['strategy']!r}; there are {', '.join(STRATEGIES)}"


def _called(data: dict, rule: dict) -> str:
    return rule.get("name") or f"rule-{data['rules'].index(rule) + 1}"


# The only version, and what holds where a rule says nothing.
WATCH_VERSION, DEFAULT_STRATEGY, DEFAULT_PATTERNS, DEFAULT_DEBOUNCE_MS = 1, "merge", ("**/*.md",), 300


def watch_config(data: dict, base_dir: str) -> WatchConfig:
    """Rules with their defaults; relative places lie below ``base_dir``. A ValueError has all that is wrong."""
    if faults := list(_faults(data)):
        raise ValueError("; ".join(faults))
    below = lambda p: os.path.normpath(os.path.join(base_dir, p))
    quiet = duration_ms(data.get("debounce")) or DEFAULT_DEBOUNCE_MS
    rules = tuple(
        WatchRule(
            name=_called(data, r), sources=tuple(map(below, r["sources"])), strategy=r.get("strategy") or DEFAULT_STRATEGY, patterns=tuple(r.get("patterns") or DEFAULT_PATTERNS),
            debounce_ms=duration_ms(r.get("debounce")) or quiet, patch_fields=tuple(r.get("patchFields") or ()),
        )
        for r in data["rules"]
    )
    return WatchConfig(rules, below(data.get("knowledgeDir") or os.path.join(".kb", "knowledge")), quiet)


def load_watch_config(path: str, default_name: str = ".watch.yaml") -> WatchConfig:
    if yaml is None:
        raise ImportError("watch rules need the yaml library")
    file = os.path.join(path, default_name) if os.path.isdir(path) else path
    with open(file, encoding="utf-8") as f:
        return watch_config(yaml.safe_load(f) or {}, os.path.dirname(os.path.abspath(file)))
