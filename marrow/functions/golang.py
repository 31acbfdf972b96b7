"""Imports and top-level declarations of Go source, read by a small tokenizer."""

from __future__ import annotations

import re
from bisect import bisect_right

_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[^\W\d]\w*|\d[\w.]*|[(){}\[\];,.*~|=:&<>!+\-/%^]|\n", re.S
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: After these a newline ends a statement.
_ENDS = re.compile(r"[\w)\]}`\"'+\-]\Z")


class GoSyntaxError(ValueError):
    """The text is no Go source that can be read."""


def parse(content: str) -> tuple[list[str], list[str], list[dict]]:
    """Imports, display names and symbols (kind, name, receiver, package, exported, start_line, end_line) in order."""
    text = content.removeprefix("\ufeff")
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    tokens: list[tuple[str, int]] = []
    at = 0
    for m in _TOKEN.finditer(text):
        if text[at : m.start()].strip(" \t\r\n"):
            raise GoSyntaxError(f"unexpected text at {at}")
        at = m.end()
        t = m[0]
        if t.startswith("//") or (t.startswith("/*") and "\n" not in t):
            continue
        if t == "\n" or t.startswith("/*"):
            if tokens and tokens[-1][0] != ";" and (_ENDS.search(tokens[-1][0]) and tokens[-1][0] not in ("import", "func", "type", "package", "var", "const", "struct", "interface", "map", "chan")):
                if tokens[-1][0] not in ("+", "-") or (len(tokens) > 1 and tokens[-2][0] == tokens[-1][0]):
                    tokens.append((";", m.start()))
            continue
        tokens.append((t, m.start()))
    if text[at:].strip(" \t\r\n"):
        raise GoSyntaxError(f"unexpected text at {at}")
    partner: dict[int, int] = {}
    stack: list[int] = []
    for k, (t, _) in enumerate(tokens):
        if t in _OPEN:
            stack.append(k)
        elif t in _CLOSE:
            if not stack or _OPEN[tokens[stack[-1]][0]] != t:
                raise GoSyntaxError("unbalanced brackets")
            partner[k], partner[stack[-1]] = stack[-1], k
            stack.pop()
    if stack:
        raise GoSyntaxError("unbalanced brackets")

    def line(k: int) -> int:
        t, p = tokens[k]
        return bisect_right(starts, p + (len(t) if t[0] == "`" else 1) - 1)

    imports: list[str] = []
    names: list[str] = []
    symbols: list[dict] = []
    package = ""

    def add(kind: str, name: str, receiver: str, first: int, last: int, display: str) -> None:
        if display not in names:
            names.append(display)
        symbols.append({"kind": kind, "name": name, "receiver": receiver, "package": package, "exported": name[:1].isupper(), "start_line": line(first), "end_line": line(last)})

    def type_spec(k: int, end: int) -> None:
        name, j = tokens[k][0], k + 1
        if j < end and tokens[j][0] == "[" and partner[j] + 1 < end and partner[j] > j + 1 and re.match(r"[^\W\d]", tokens[j + 1][0]) and tokens[j + 2][0] != "]":
            j = partner[j] + 1
        if j < end and tokens[j][0] == "=":
            j += 1
        kind = tokens[j][0] if j < end and tokens[j][0] in ("struct", "interface") else "type"
        add(kind, name, "", k, end - 1, f"{kind} {name}")

    k = 0
    n = len(tokens)
    while k < n:
        t = tokens[k][0]
        if t == ";":
            k += 1
            continue
        end = k
        while end < n and tokens[end][0] != ";":
            end = partner[end] + 1 if tokens[end][0] in _OPEN else end + 1
        if t == "package" and k + 1 < n:
            package = tokens[k + 1][0]
        elif not package:
            raise GoSyntaxError("no package clause")
        elif t == "import":
            for j in range(k + 1, end):
                if tokens[j][0][:1] in "\"`" and (p := tokens[j][0].strip("\"`")) and p not in imports:
                    imports.append(p)
        elif t == "func" and k + 1 < n:
            receiver = shown = ""
            j = k + 1
            if tokens[j][0] == "(":
                inside = [x for x, _ in tokens[j + 1 : partner[j]]]
                base = [x for x in (inside[: inside.index("[")] if "[" in inside else inside) if re.match(r"[^\W\d]", x)]
                receiver = base[-1] if base else "receiver"
                shown = f"(*{receiver})." if "*" in inside else f"{receiver}."
                j = partner[j] + 1
            if j >= n or not re.match(r"[^\W\d]", tokens[j][0]):
                raise GoSyntaxError("no name of a function")
            add("method" if receiver else "function", tokens[j][0], receiver, k, end - 1, shown + tokens[j][0])
        elif t == "type" and k + 1 < n:
            if tokens[k + 1][0] == "(":
                j, close = k + 2, partner[k + 1]
                while j < close:
                    if tokens[j][0] == ";":
                        j += 1
                        continue
                    stop = j
                    while stop < close and tokens[stop][0] != ";":
                        stop = partner[stop] + 1 if tokens[stop][0] in _OPEN else stop + 1
                    type_spec(j, stop)
                    j = stop
            else:
                type_spec(k + 1, end)
        elif t not in ("var", "const"):
            raise GoSyntaxError(f"unexpected {t}")
        k = end
    if not package:
        raise GoSyntaxError("no package clause")
    return imports, names, symbols
