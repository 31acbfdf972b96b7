"""Quality rules over concepts, each a Column that makes an array of issues, and their summary.

Lengths are bytes. Issues come in the order of the rules within a concept; shared titles come last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.functions.text import nz, ufold, utrim

ISSUE = "array<struct<code:string,severity:string,line:int,message:string,suggestion:string>>"
SEVERITY_RANK = {"ERROR": 0, "WARN": 1, "INFO": 2}
#: Most overlong lines reported of a concept: a feature of the rule.
MOST_LONG_LINES = 6


@dataclass(frozen=True)
class Config:
    max_line_length: int = 240
    min_description_length: int = 10
    required_tags: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    issues: Callable[[Config], Column]


def _issue(code: str, severity: str, line: Column | int, message: Column | str, suggestion: str = "") -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), (line if isinstance(line, Column) else F.lit(line)).cast("int").alias("line"),
        (message if isinstance(message, Column) else F.lit(message)).alias("message"), F.lit(suggestion).alias("suggestion"),
    )


def _when(condition: Column, code: str, severity: str, line: int, message: Column | str, suggestion: str = "") -> Column:
    return F.when(condition, F.array(_issue(code, severity, line, message, suggestion))).otherwise(F.array().cast(ISSUE))


def _tags() -> Column:
    return F.coalesce(F.col("tags"), F.array().cast("array<string>"))


def timestamp_is_valid(c: Column) -> Column:
    """RFC 3339 with an offset or ``Z``, or a plain date; the calendar counts, fractions are allowed."""
    date = F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    shape = c.rlike(r"\A\d{4}-\d{2}-\d{2}(T([01]\d|2[0-3]):[0-5]\d:[0-5]\d([.,]\d+)?(Z|[+-]([01]\d|2[0-4]):([0-5]\d|60)))?\z")
    return shape & date


def _long_lines(cfg: Config) -> Column:
    lines = F.transform(F.split(nz("content"), "\n"), lambda x, i: F.struct(i.alias("i"), F.octet_length(x).alias("n")))
    over = F.slice(F.filter(lines, lambda x: x["n"] > cfg.max_line_length), 1, MOST_LONG_LINES)
    return F.transform(over, lambda x: _issue("KB009", "WARN", x["i"] + 8, F.concat(F.lit("Line length "), x["n"].cast("string"), F.lit(f" exceeds {cfg.max_line_length}")), "Break long lines"))


def _tag_form(_: Config) -> Column:
    one = lambda t: F.array_compact(
        F.array(
            F.when(ufold(t) != t, _issue("KB006", "WARN", 5, F.concat(F.lit("Tag is not lower case: "), t), "Write tags in lower case")),
            F.when(t.contains(" "), _issue("KB006", "WARN", 5, F.concat(F.lit("Tag contains a space: "), t), "Use hyphens")),
        )
    )
    return F.flatten(F.transform(_tags(), one))


def _repeated_tag(_: Config) -> Column:
    tags = _tags()
    again = F.filter(tags, lambda t, i: F.array_position(tags, t) <= i)
    return F.when(F.size(again) > 0, F.array(_issue("KB010", "WARN", 5, F.concat(F.lit("Duplicate tag: "), F.element_at(again, 1)), "Remove the repetition"))).otherwise(F.array().cast(ISSUE))


def _required(cfg: Config) -> Column:
    if not cfg.required_tags:
        return F.array().cast(ISSUE)
    missing = F.filter(F.array(*(F.lit(t) for t in cfg.required_tags)), lambda t: ~F.coalesce(F.array_contains(_tags(), t), F.lit(False)))
    return F.transform(missing, lambda t: _issue("KB011", "WARN", 5, F.concat(F.lit("Required tag is missing: "), t), "Add the tag"))


def _timestamp(_: Config) -> Column:
    t = nz("timestamp")
    return F.when(t == "", F.array(_issue("KB005", "WARN", 6, "Timestamp is missing", "Add an RFC 3339 timestamp"))).otherwise(_when(~timestamp_is_valid(t), "KB005", "WARN", 6, "Timestamp is not RFC 3339", "Use RFC 3339 or yyyy-MM-dd"))


#: Rules in the order of their issues. Codes are fixed values; the rule on shared titles needs all rows and stands apart.
RULES = [
    Rule("KB001", "ERROR", lambda _: _when(utrim(nz("type")) == "", "KB001", "ERROR", 1, "Type is missing", "Add a type")),
    Rule("KB002", "ERROR", lambda _: _when(utrim(nz("title")) == "", "KB002", "ERROR", 1, "Title is missing", "Add a title")),
    Rule("KB003", "WARN", lambda c: _when(F.octet_length(utrim(nz("description"))) < c.min_description_length, "KB003", "WARN", 3, "Description is missing or short", "Describe the concept")),
    Rule("KB004", "WARN", lambda _: _when((nz("type") != "") & ~nz("type").rlike(r"\A[a-z][a-z0-9_]*\z"), "KB004", "WARN", 1, "Type is not in snake case", "Use lower-case snake case")),
    Rule("KB005", "WARN", _timestamp),
    Rule("KB006", "WARN", _tag_form),
    Rule("KB007", "WARN", lambda _: _when(utrim(nz("content")) == "", "KB007", "WARN", 8, "Content is empty", "Write a body")),
    Rule("KB009", "WARN", _long_lines),
    Rule("KB010", "WARN", _repeated_tag),
    Rule("KB011", "WARN", _required),
]


def lint(concepts: DataFrame, config: Config = Config(), rules: list[Rule] | None = None) -> DataFrame:  # noqa: B008
    """One row per issue: ord, file_path, seq (its place within the concept), code, severity, line, message, suggestion."""
    found = F.concat(*(r.issues(config) for r in (RULES if rules is None else rules)))
    # issues are made where a concept is read; concepts delivered again are dropped afterwards, without their contents
    checked = concepts.select("ord", nz("file_path").alias("file_path"), nz("title").alias("title"), found.alias("found")).dropDuplicates(["ord"])
    rows = checked.select("ord", "file_path", F.posexplode("found").alias("seq", "i")).select("ord", "file_path", "seq", "i.*")
    titles = concepts.select("ord", nz("file_path").alias("file_path"), nz("title").alias("title")).dropDuplicates(["ord"])
    # counts are combined in each task before they are shuffled; a title that very many share is one row there
    shared = titles.groupBy("title").agg(F.count("*").alias("n")).where("n > 1")
    twice = titles.join(shared, "title").select(
        "ord", "file_path", F.lit(1_000_000).alias("seq"), F.lit("KB013").alias("code"), F.lit("WARN").alias("severity"), F.lit(0).alias("line"),
        F.concat(F.lit("Title is shared: "), "title").alias("message"), F.lit("Give each concept its own title").alias("suggestion"),
    )
    return rows.unionByName(twice)


def summary(issues: DataFrame) -> DataFrame:
    count = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, 1).otherwise(0)), F.lit(0)).cast("long")
    return issues.agg(count("ERROR").alias("errors"), count("WARN").alias("warnings"), count("INFO").alias("infos"))


def passes(issues: DataFrame, strict: bool = False) -> bool:
    """The gate: no errors, and with ``strict`` no warnings either."""
    r = summary(issues).first()
    return not r["errors"] and not (strict and r["warnings"])


def title_counts(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy(nz("title").alias("title")).agg(F.count("*").alias("n"))


