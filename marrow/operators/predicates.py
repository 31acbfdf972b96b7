"""Structured and full-text filters over concepts, each one Column; a query is their conjunction.

Concepts are rows of ``ord, type, title, description, resource, tags, timestamp, content, file_path, custom``. An
empty criterion is inactive and adds no predicate. Cheap equalities come first, patterns last.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.functions.text import afold, afold_text, clean_path, fold, norm_key, norm_text, nz, regex_matches, ufold, utrim

# Fixed formats of lines in generated bodies.
SYMBOL_LINE = r"\A- `([^`]+)` `([^`]+)` \(([^)]+)\) at `([^`]+)`\z"
LANGUAGE_LINE = r"(?m)(?d)^- Language: `([^`]+)`$"
PATH_LINE = r"(?m)(?d)^- Path: `([^`]+)`$"
RELATION_ROW = r"\A\| ([^|]+) \| `([^`]+)` \| `([^`]+)` \| `([^`]+)` \| ([^|]+) \|\z"


def custom(key: str) -> Column:
    """A custom field, absent as the empty string."""
    return nz(F.try_element_at(F.col("custom"), F.lit(key)))


def _trimmed_lines(content: Column) -> Column:
    return F.transform(F.split(content, "\n"), utrim)


def symbols(content: Column) -> Column:
    """Symbol lines of a body: array of (kind, name, visibility, location) in order."""
    return F.transform(
        F.filter(_trimmed_lines(content), lambda x: x.rlike(SYMBOL_LINE)),
        lambda x: F.struct(*(F.regexp_extract(x, SYMBOL_LINE, k).alias(n) for k, n in enumerate(("kind", "name", "visibility", "location"), 1))),
    )


def relation_rows(content: Column) -> Column:
    """Rows of relation tables of a body: array of (kind, source, target, location, detail) in order."""
    return F.transform(
        F.filter(_trimmed_lines(content), lambda x: x.rlike(RELATION_ROW)),
        lambda x: F.struct(*(utrim(F.regexp_extract(x, RELATION_ROW, k)).alias(n) for k, n in enumerate(("kind", "source", "target", "location", "detail"), 1))),
    )


def has_text(text: str) -> Column:
    t = fold(text)
    return ufold(nz("title")).contains(t) | ufold(nz("description")).contains(t) | ufold(nz("content")).contains(t)


def has_tags(tags: list[str] | tuple[str, ...]) -> Column:
    have = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    out = F.lit(True)
    for t in tags:
        out = out & F.coalesce(F.array_contains(have, t), F.lit(False))
    return out


def _any_line(pattern: str, test) -> Column:
    return F.exists(F.regexp_extract_all(nz("content"), F.lit(pattern), F.lit(1)), test)


def code_language(v: str) -> Column:
    k = norm_text(v)
    return (norm_key(custom("language")) == k) | _any_line(LANGUAGE_LINE, lambda x: norm_key(x) == k)


def code_file_path(v: str) -> Column:
    k = norm_text(v)
    return norm_key(custom("source_path")).contains(k) | _any_line(PATH_LINE, lambda x: norm_key(x).contains(k))


def code_symbol_kind(v: str) -> Column:
    k = norm_text(v)
    return (norm_key(custom("symbol_kind")) == k) | F.exists(symbols(nz("content")), lambda s: norm_key(s["kind"]) == k)


def code_qualified_name(v: str) -> Column:
    k = norm_text(v)
    return (
        norm_key(custom("qualified_name")).contains(k)
        | F.exists(symbols(nz("content")), lambda s: norm_key(s["name"]).contains(k))
        | F.exists(relation_rows(nz("content")), lambda r: norm_key(r["source"]).contains(k) | norm_key(r["target"]).contains(k))
    )


def code_relation_kind(v: str) -> Column:
    k = norm_text(v)
    return (norm_key(custom("relation_kind")) == k) | F.exists(relation_rows(nz("content")), lambda r: norm_key(r["kind"]) == k)


def code_relation_source(v: str) -> Column:
    k = norm_text(v)
    return norm_key(custom("relation_source")).contains(k) | F.exists(relation_rows(nz("content")), lambda r: norm_key(r["source"]).contains(k))


def code_relation_target(v: str) -> Column:
    k = norm_text(v)
    return norm_key(custom("relation_target")).contains(k) | F.exists(relation_rows(nz("content")), lambda r: norm_key(r["target"]).contains(k))


@dataclass(frozen=True)
class Query:
    """Criteria that all must hold; empty ones are inactive."""

    type: str = ""
    tags: tuple[str, ...] = field(default=())
    resource: str = ""
    text: str = ""
    title_regex: str = ""
    description_regex: str = ""
    content_regex: str = ""
    code_language: str = ""
    code_file_path: str = ""
    code_symbol_kind: str = ""
    code_qualified_name: str = ""
    code_relation_kind: str = ""
    code_relation_source: str = ""
    code_relation_target: str = ""

    def with_(self, **criteria) -> Query:
        """A copy with further criteria."""
        return replace(self, **criteria)

    def active(self) -> int:
        return sum(bool(getattr(self, f.name)) for f in fields(self))

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.type:
            out = out & (F.col("type") == self.type)
        if self.tags:
            out = out & has_tags(self.tags)
        if self.resource:
            out = out & ufold(nz("resource")).contains(fold(self.resource))
        if self.text:
            out = out & has_text(self.text)
        for name, test in (("code_language", code_language), ("code_file_path", code_file_path), ("code_symbol_kind", code_symbol_kind), ("code_qualified_name", code_qualified_name), ("code_relation_kind", code_relation_kind), ("code_relation_source", code_relation_source), ("code_relation_target", code_relation_target)):
            if v := getattr(self, name):
                out = out & test(v)
        for name in ("title", "description", "content"):
            if v := getattr(self, f"{name}_regex"):
                out = out & regex_matches(nz(name), v)
        return out

    def execute(self, concepts: DataFrame) -> DataFrame:
        """Matching rows; their order is that of ``ord``."""
        return concepts.where(self.predicate())


def search(concepts: DataFrame, text: str) -> DataFrame:
    """Full-text search with Unicode folding; an empty text finds everything."""
    return concepts.where(has_text(text)) if text else concepts


def search_with_matches(concepts: DataFrame, text: str) -> DataFrame:
    """Search that also finds rows by the names of their symbols; ``symbol_matches`` are the symbols whose name holds the text."""
    if not text:
        return concepts.withColumn("symbol_matches", F.filter(symbols(nz("content")), lambda _: F.lit(False)))
    t = fold(text)
    with_matches = concepts.withColumn("symbol_matches", F.filter(symbols(nz("content")), lambda s: ufold(s["name"]).contains(t)))
    return with_matches.where(has_text(text) | (F.size("symbol_matches") > 0))


def search_ascii(concepts: DataFrame, text: str) -> DataFrame:
    """Search that folds ASCII letters only; an empty text finds everything."""
    t = afold_text(text)
    return concepts.where(afold(nz("title")).contains(t) | afold(nz("description")).contains(t) | afold(nz("content")).contains(t))


def indexed_by_type(concepts: DataFrame, type_: str) -> DataFrame:
    """Rows of a type; the empty type finds nothing."""
    return concepts.where((F.col("type") == type_) & (F.col("type") != ""))


def indexed_by_tag(concepts: DataFrame, tag: str) -> DataFrame:
    """Rows with a tag, one for each time that they have it."""
    return concepts.withColumn("_tag", F.explode("tags")).where(F.col("_tag") == tag).drop("_tag")


def by_type(concepts: DataFrame, type_: str) -> DataFrame:
    return concepts.where(nz("type") == type_)


def by_tag(concepts: DataFrame, tag: str) -> DataFrame:
    return concepts.where(F.coalesce(F.array_contains("tags", tag), F.lit(False)))


def by_resource(concepts: DataFrame, resource: str) -> DataFrame:
    return concepts.where(nz("resource") == resource)


EXACT_FIELDS = ("language", "symbol_kind", "qualified_name", "relation_kind")


def source_path() -> Column:
    """Source path of a concept: its custom field, else its resource (without the scheme of the repository), cleaned."""
    own, resource = custom("source_path"), nz("resource")
    inside = "code://repo/"
    raw = F.when(utrim(own) != "", own).when(resource.startswith(inside), F.substring(resource, len(inside) + 1, 1 << 30)).otherwise(resource)
    return F.when((utrim(own) == "") & (resource == ""), "").otherwise(clean_path(raw))


def exact_filter(**filters: str) -> Column:
    """Exact filters applied after a query: type, tag, path, language, symbol_kind, qualified_name, relation_*; empty ones are inactive."""
    out = F.lit(True)
    for name, v in filters.items():
        if not v:
            continue
        if name == "type":
            out = out & (nz("type") == v)
        elif name == "tag":
            out = out & has_tags([v])
        elif name == "path":
            out = out & (source_path() == clean_path(F.lit(v)))
        elif name == "language":
            out = out & (ufold(custom("language")) == fold(v))
        elif name in ("symbol_kind", "qualified_name", "relation_kind"):
            out = out & (custom(name) == v)
        elif name in ("relation_source", "relation_target"):
            out = out & (F.when(custom(name) == "", "").otherwise(clean_path(custom(name))) == clean_path(F.lit(v)))
        else:
            raise ValueError(f"no such filter: {name}")
    return out


def dispatch_search(concepts: DataFrame, text: str = "", type_: str = "", tag: str = "", legacy: bool = False, **code: str) -> DataFrame:
    """Search of the command line: text, type, tag and code criteria together.

    With ``legacy`` code criteria count only when there is no text.
    """
    q = Query(**{k: v for k, v in code.items() if v})
    if text:
        found = search_with_matches(concepts, text)
        if not legacy:
            found = found.where(q.predicate())
    else:
        found = q.execute(search_with_matches(concepts, ""))
    if type_:
        found = by_type(found, type_)
    return by_tag(found, tag) if tag else found
