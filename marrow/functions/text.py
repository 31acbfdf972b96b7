"""Scalar functions on text, paths and patterns, as columns of built-in functions that stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Unicode white space; Spark's own trim takes spaces only.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nz(c: Column | str) -> Column:
    """NULL as the empty string: both mean absent."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def utrim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def ufold(c: Column) -> Column:
    """Lower case rune by rune (Spark maps a dotted capital I to two characters, and a final sigma by its place)."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def fold(text: str) -> str:
    """``ufold`` of a Python string."""
    return text.translate({0x130: "i", 0x3A3: "σ"}).lower()


def afold(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, _UPPER, _LOWER)


def afold_text(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def norm_key(c: Column) -> Column:
    return ufold(utrim(c))


def norm_text(text: str) -> str:
    return fold(text.strip(SPACE))


def clean_path(c: Column) -> Column:
    """Shortest equal path: no empty, ``.`` or avoidable ``..`` parts; the empty path is ``.``."""
    rooted = c.startswith("/")
    parts = F.aggregate(
        F.filter(F.split(c, "/"), lambda x: (x != "") & (x != ".")),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x)))
        .when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(rooted, acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    # the fold runs only for paths that need it
    plain = ~c.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.when(plain, c).when(joined == "", ".").otherwise(joined)


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def dir_name(c: Column) -> Column:
    """Parent of a path; of a bare name it is ``.``."""
    return F.when(c.contains("/"), F.regexp_replace(c, r"/[^/]*$", "")).otherwise(".")


def extension(c: Column) -> Column:
    """The part of the name from its last dot on, with the dot."""
    return F.regexp_extract(base_name(c), r"(\.[^.]*)$", 1)


# --- patterns -------------------------------------------------------------------------------------------------

_NOT_RE2 = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9kGXRZ]|[*+?}]\+|\(\?[a-zA-Z-]*U")


def linear_regex(pattern: str) -> str | None:
    """A pattern of the linear-time dialect as one of Java, or None if it is no pattern there.

    Only a newline ends a line; ``$`` without ``(?m)`` is the end of the text; ``\\s`` is ASCII without vertical tab.
    """
    if _NOT_RE2.search(re.sub(r"\\\\", "", pattern)):
        return None
    multiline = bool(re.match(r"\(\?[a-zA-Z]*m", pattern))
    out, k, in_class = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            two = pattern[k : k + 2]
            if two == "\\s":
                out.append("\\t\\n\\f\\r " if in_class else "[\\t\\n\\f\\r ]")
            elif two == "\\S" and not in_class:
                out.append("[^\\t\\n\\f\\r ]")
            elif two == "\\z":
                out.append("\\z")
            elif two == "\\C":
                return None
            else:
                out.append(two)
            k += 2
            continue
        if c == "[":
            # a bracket within a class is a character; Java would open a nested class
            out.append("\\[" if in_class and not pattern.startswith("[:", k) else c)
            if not in_class:
                in_class = True
                if pattern[k + 1 : k + 2] == "^":
                    out.append("^")
                    k += 1
                if pattern[k + 1 : k + 2] == "]":
                    out.append("\\]")
                    k += 1
            elif pattern.startswith("[:", k) and (end := pattern.find(":]", k)) > 0:
                out[-1] = {"[:alpha:]": "a-zA-Z", "[:digit:]": "0-9", "[:alnum:]": "a-zA-Z0-9", "[:space:]": "\\t\\n\\x0B\\f\\r ", "[:upper:]": "A-Z", "[:lower:]": "a-z", "[:word:]": "\\w"}.get(pattern[k : end + 2], "")
                if not out[-1]:
                    return None
                k = end + 1
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        elif c == "&" and in_class and pattern[k + 1 : k + 2] == "&":
            out.append("\\&")
        elif c == "$" and not in_class and not multiline:
            out.append("\\z")
        elif pattern.startswith("(?P<", k) and not in_class:
            out.append("(?<")
            k += 3
        else:
            out.append(c)
        k += 1
    return "(?d)" + "".join(out)


def regex_matches(c: Column, pattern: str) -> Column:
    """Search, case-sensitive; a pattern that is invalid matches nothing."""
    java = linear_regex(pattern)
    spark = SparkSession.getActiveSession()
    if java is None or spark is None:
        return F.lit(False)
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception:  # noqa: BLE001  the JVM's PatternSyntaxException
        return F.lit(False)
    return F.coalesce(c.rlike(java), F.lit(False))


def segment_regex(token: str) -> str | None:
    """A glob of one path segment (``*``, ``?``, ``[a-z]``, ``[^a]``, ``\\x``) as a pattern; None if malformed."""
    out, k = [], 0
    while k < len(token):
        c = token[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            k += 1
            if k >= len(token):
                return None
            out.append(re.escape(token[k]))
        elif c == "[":
            m = re.compile(r"\[(\^?)((?:\\.|[^\\\]])(?:\\.|[^\\\]])*)\]").match(token, k)
            if not m or m[2].startswith("-") or re.search(r"-$", m[2]):
                return None
            body = re.sub(r"\\(.)|([\[&^])", lambda x: "\\" + (x[1] or x[2]), m[2])
            out.append(f"[{'^/' if m[1] else ''}{body}]")
            k = m.end() - 1
        else:
            out.append(re.escape(c))
        k += 1
    return "".join(out)


def glob_tokens(pattern: str) -> list[str]:
    """Segments of a pattern; ``**`` glued after text repeats the text as a segment of its own before it."""
    tokens: list[str] = []
    for part in pattern.split("/"):
        at = part.find("**")
        if part == "**" or at < 0:
            tokens.append(part)
        elif at == 0:
            tokens.append(part.replace("**", "*"))
        else:
            tokens += [part[:at], part]
    return tokens


def glob_regex(pattern: str) -> str | None:
    """Anchored pattern for a path whose segments are each followed by a slash."""
    out = []
    for token in glob_tokens(pattern):
        if token == "**":
            out.append("(?:[^/]*/)*")
            continue
        one = segment_regex(token)
        if one is None:
            return None
        out.append(one + "/")
    return "(?s)\\A" + "".join(out) + "\\z"


def glob_matches(path: Column, pattern: str) -> Column:
    """Whether a path matches a glob whose ``**`` stands for any number of whole segments."""
    java = glob_regex(pattern)
    return F.lit(False) if java is None else F.concat(path, F.lit("/")).rlike(java)


def simple_glob_matches(path: Column, pattern: str) -> Column:
    """Whether a whole path or its last part matches a glob without ``**``."""
    one = segment_regex(pattern)
    if one is None:
        return F.lit(False)
    whole = "(?s)\\A" + one + "\\z"
    return path.rlike(whole) | base_name(path).rlike(whole)
