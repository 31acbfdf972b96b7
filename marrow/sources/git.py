"""Version control as tables: tracked files, commits with their files, differences between commits."""

from __future__ import annotations

import datetime as dt
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

COMMITS = "hash string, short string, author string, email string, at timestamp, subject string, body string, added array<string>, modified array<string>, deleted array<string>"
_FORMAT = "%H%x1e%h%x1e%an%x1e%ae%x1e%aI%x1e%s%x1e%b%x1f"


def run(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout.decode("utf-8", "replace")


def root(repo: str) -> str:
    return run(repo, "rev-parse", "--show-toplevel").strip()


def head(repo: str) -> str:
    return run(repo, "rev-parse", "HEAD").strip()


def name_status(raw: str) -> list[tuple[str, str]]:
    """(status, path) of a NUL-separated listing: a rename is the old path deleted and the new one modified, a copy the new one modified."""
    parts = raw.lstrip("\n").split("\0")
    out, k = [], 0
    while k + 1 < len(parts):
        status = parts[k].strip()
        if not status:
            k += 1
            continue
        if status[0] in "RC" and k + 2 < len(parts):
            if status[0] == "R":
                out.append(("D", parts[k + 1]))
            out.append(("M", parts[k + 2]))
            k += 3
        else:
            out.append((status[0], parts[k + 1]))
            k += 2
    return out


def commits(repo: str, count: int) -> list[tuple]:
    rows = []
    for record in run(repo, "log", f"-{count}", f"--format={_FORMAT}").split("\x1f"):
        f = record.strip("\n").split("\x1e")
        if len(f) < 7:
            continue
        files = name_status(run(repo, "show", "--name-status", "-z", "--format=", f[0]))
        at = dt.datetime.fromisoformat(f[4]).astimezone(dt.UTC)
        rows.append((*f[:4], at, f[5], f[6].strip(), *([p for s, p in files if s in kinds] for kinds in ("A", "MT", "D"))))
    return rows


def commit_table(spark: SparkSession, repo: str, count: int = 50) -> DataFrame:
    return spark.createDataFrame(commits(repo, count), COMMITS)


def tracked_files(repo: str) -> list[str]:
    return [p for p in run(repo, "ls-files", "-z").split("\0") if p]


def changed_files(repo: str, old: str, new: str) -> list[str]:
    """Paths that differ between two commits, both ends of a rename among them, sorted."""
    parts = run(repo, "diff", "--name-status", "-z", f"{old}..{new}").split("\0")
    paths, k = set(), 0
    while k + 1 < len(parts):
        if parts[k][:1] == "R":
            paths |= {parts[k + 1], parts[k + 2]}
            k += 3
        elif parts[k][:1] == "C":
            paths.add(parts[k + 2])
            k += 3
        else:
            paths.add(parts[k + 1])
            k += 2
    return sorted(p for p in paths if p)


def file_table(spark: SparkSession, repo: str, repository_id: str = "") -> DataFrame:
    """(repository_id, path, size, content, modified_at) of the tracked files that are there."""
    from marrow.operators.codegraph import repository_id as name_of

    base = root(repo)
    rows = []
    for p in tracked_files(base):
        full = os.path.join(base, p)
        if os.path.isfile(full):
            with open(full, "rb") as f:
                text = f.read().decode("utf-8", "replace")
            s = os.stat(full)
            rows.append((repository_id or name_of(base), p, s.st_size, text, dt.datetime.fromtimestamp(s.st_mtime, dt.UTC)))
    return spark.createDataFrame(rows, "repository_id string, path string, size long, content string, modified_at timestamp")


def change_log(spark: SparkSession, repo: str) -> DataFrame:
    """(path, hash, author, at) of every file of every commit, from one run of the log."""
    rows, meta = [], None
    for line in run(repo, "log", "--name-only", "--format=%x1e%H%x1f%an%x1f%aI").split("\n"):
        if line.startswith("\x1e"):
            h, author, at = line[1:].split("\x1f")
            meta = (h, author, dt.datetime.fromisoformat(at).astimezone(dt.UTC))
        elif line and meta:
            rows.append((line, *meta))
    return spark.createDataFrame(rows, "path string, hash string, author string, at timestamp")
