"""Hooks of version control that keep the knowledge of a repository up to date, or hold back what does not pass the lint."""

from __future__ import annotations

import os
import shlex
import sys

from marrow.sources import git

MARK = "# written by marrow; edit or remove it as you like"
#: Of each hook: the command that runs, and whether its failure stops the commit or push.
HOOKS = {"post-commit": (("update",), False), "pre-commit": (("lint",), True), "pre-push": (("init", "--force"), False)}


class HookError(ValueError):
    """A hook that is not known, or that would replace one of somebody else."""


def place(repo: str, kind: str) -> str:
    if kind not in HOOKS:
        raise HookError(f"there is no hook {kind!r}, only {', '.join(HOOKS)}")
    return os.path.join(git.root(repo), ".git", "hooks", kind)


def script(repo: str, kind: str, python: str = sys.executable) -> str:
    words, stops = HOOKS[kind]
    package = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    command = " ".join(map(shlex.quote, [python, "-m", "marrow.cli", *words, "--repo", git.root(repo)]))
    return f"#!/bin/sh\n{MARK}\nPYTHONPATH={shlex.quote(package)}${{PYTHONPATH:+:$PYTHONPATH}} {command}" + ("\n" if stops else " >/dev/null 2>&1 || :\n")


def installed(repo: str, kind: str) -> str:
    """``own``, ``other`` or nothing, by what lies in the hook's place."""
    path = place(repo, kind)
    if not os.path.exists(path):
        return ""
    with open(path, encoding="utf-8", errors="replace") as f:
        return "own" if MARK in f.read().split("\n") else "other"


def install(repo: str, kind: str = "post-commit", force: bool = False) -> bool:
    """Write a hook; whether there was need to. A hook of somebody else is replaced only by ``force``."""
    there = installed(repo, kind)
    if there == "other" and not force:
        raise HookError(f"another {kind} hook is there already; force replaces it")
    if there == "own" and not force:
        return False
    path = place(repo, kind)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(script(repo, kind))
    os.chmod(path, 0o755)
    return True


def uninstall(repo: str, kind: str = "post-commit") -> bool:
    """Remove a hook, whoever wrote it; whether there was one."""
    path = place(repo, kind)
    if not os.path.exists(path):
        return False
    os.remove(path)
    return True
