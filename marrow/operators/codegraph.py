"""Source files to code entities and relations, and the reports over them.

A summary is a row per file: repository_id, path, type, size, line_count, imports, functions, symbols, warnings.
Entities and relations are unions of projections of the summaries; only Go needs a parser in Python, everything else
is regular expressions in generated code.
"""

from __future__ import annotations

import hashlib
import posixpath
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions.golang import GoSyntaxError, parse
from marrow.functions.text import base_name, extension, linear_regex, nz, utrim
from marrow.operators import rank

SYMBOL = "struct<kind:string,name:string,receiver:string,package:string,exported:boolean,start_line:int,end_line:int>"
FILE_RESOURCE = "code://repo/"

# Fixed table: types of files by extension.
FILE_TYPES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".rs": "rust", ".java": "java",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".rb": "ruby", ".sh": "shell", ".bash": "shell", ".md": "markdown",
    ".markdown": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml",
}

# Fixed patterns: imports of a line, by type of file.
IMPORTS = {
    "go": [r'^\s*import\s+"([^"]+)"', r'^\s*"([^"]+)"'],
    "python": [r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import"],
    "javascript": [r"""^\s*(?:import|from)\s+['"]([^'"]+)['"]""", r"""^\s*require\(['"]([^'"]+)['"]\)"""],
    "typescript": [r"""^\s*(?:import|from)\s+['"]([^'"]+)['"]""", r"""^\s*require\(['"]([^'"]+)['"]\)"""],
}

# Fixed patterns: functions and types of a line, by type of file.
FUNCTIONS = {
    "go": [r"^\s*func\s+(?:\([^)]+\)\s+)?(\w+)\s*\("],
    "python": [r"^\s*def\s+(\w+)\s*\(", r"^\s*class\s+(\w+)\s*[:\(]"],
    "javascript": [r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", r"^\s*const\s+(\w+)\s*=\s*(?:async\s+)?\("],
    "typescript": [r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", r"^\s*(?:export\s+)?(?:class|interface|type)\s+(\w+)"],
    "java": [r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:[\w<>]+\s+)?(\w+)\s*\("],
    "rust": [r"^\s*fn\s+(\w+)\s*\(", r"^\s*(?:pub\s+)?struct\s+(\w+)"],
    "c": [r"^\s*(?:[\w*\s]+)\s+(\w+)\s*\([^;]*$"],
    "cpp": [r"^\s*(?:[\w*\s]+)\s+(\w+)\s*\([^;]*$", r"^\s*(?:class|struct)\s+(\w+)"],
    "ruby": [r"^\s*def\s+(\w+)", r"^\s*class\s+(\w+)"],
}
#: Longer names are no names of functions.
NAME_BYTES = 80


def file_type(path: Column) -> Column:
    ext = F.lower(extension(path))
    table = F.create_map(*(F.lit(x) for kv in FILE_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, ext), F.regexp_replace(ext, r"^\.", ""))


def _by_line(content: Column, kind: Column, table: dict[str, list[str]], keep=lambda x: F.lit(True)) -> Column:
    """What the patterns of a type of file find in each line, in order, without repetition."""
    empty = F.array().cast("array<string>")
    lines = F.split(content, "\n")
    out = None

    def all_of(java: list[str]):
        return lambda x: F.array(*(utrim(F.regexp_extract(x, p, 1)) for p in java))

    for name, patterns in table.items():
        found = F.flatten(F.transform(lines, all_of([linear_regex(p) for p in patterns])))
        got = F.array_distinct(F.filter(found, lambda x: (x != "") & keep(x)))
        out = F.when(kind == name, got) if out is None else out.when(kind == name, got)
    return out.otherwise(empty)


def imports(content: Column, kind: Column) -> Column:
    return _by_line(content, kind, IMPORTS)


def functions(content: Column, kind: Column) -> Column:
    return _by_line(content, kind, FUNCTIONS, lambda x: F.octet_length(x) < NAME_BYTES)


def line_count(content: Column) -> Column:
    newlines = F.length(content) - F.length(F.translate(content, "\n", ""))
    return F.when(content == "", 0).otherwise(newlines + F.when(content.endswith("\n"), 0).otherwise(1)).cast("int")


def _read_go(content: pd.Series) -> pd.DataFrame:
    rows = []
    for text in content:
        if text is None:
            rows.append((None, None, None, None))
            continue
        try:
            rows.append((*parse(text), None))
        except GoSyntaxError as e:
            rows.append((None, None, None, f"failed to parse Go: {e}"))
    return pd.DataFrame(rows, columns=["imports", "functions", "symbols", "warning"])


def _go(content: Column) -> Column:
    """Imports, functions, symbols and a warning of Go source; NULL for NULL."""
    read = F.pandas_udf(_read_go, f"struct<imports:array<string>,functions:array<string>,symbols:array<{SYMBOL}>,warning:string>")
    return read(content)


def summaries(files: DataFrame) -> DataFrame:
    """A summary of each of ``files`` (repository_id, path, size, content). Go that cannot be parsed is read by patterns, with a warning."""
    kind = file_type(F.col("path"))
    text = nz("content")
    base = files.select(nz("repository_id").alias("repository_id"), "path", kind.alias("type"), F.coalesce("size", F.octet_length(text)).cast("long").alias("size"), line_count(text).alias("line_count"), text.alias("content"))
    go = base.withColumn("go", _go(F.when(F.col("type") == "go", F.col("content"))))
    no_symbols = F.array().cast(f"array<{SYMBOL}>")
    return go.select(
        "repository_id", "path", "type", "size", "line_count",
        F.coalesce("go.imports", imports(F.col("content"), F.col("type"))).alias("imports"),
        F.coalesce("go.functions", functions(F.col("content"), F.col("type"))).alias("functions"),
        F.coalesce("go.symbols", no_symbols).alias("symbols"),
        F.array_compact(F.array("go.warning")).alias("warnings"),
    )


def package_name() -> Column:
    first = F.try_element_at(F.filter("symbols", lambda s: nz(s["package"]) != ""), F.lit(1))["package"]
    return F.coalesce(first, F.col("type"))


def display_name(s: Column) -> Column:
    return F.when(nz(s["receiver"]) != "", F.concat(s["receiver"], F.lit("."), s["name"])).otherwise(s["name"])


def qualified_name(s: Column) -> Column:
    return F.when(nz(s["package"]) != "", F.concat(s["package"], F.lit("."), display_name(s))).otherwise(display_name(s))


def relationship_graph(summaries_: DataFrame) -> DataFrame:
    """(kind, source, target, meta) of four kinds, each once, none with a blank end."""
    s = summaries_.select("path", package_name().alias("pkg"), "imports", "symbols")
    imp = s.select("path", "pkg", F.explode("imports").alias("target"))
    sym = s.select("path", F.explode("symbols").alias("s"))
    parts = [
        imp.select(F.lit("file_import").alias("kind"), F.col("path").alias("source"), "target", F.lit("").alias("meta")),
        imp.select(F.lit("package_import").alias("kind"), F.col("pkg").alias("source"), "target", F.lit("").alias("meta")),
        sym.select(F.lit("file_owns_symbol").alias("kind"), F.col("path").alias("source"), qualified_name(F.col("s")).alias("target"), nz("s.kind").alias("meta")),
        sym.select(F.lit("package_owns_symbol").alias("kind"), nz("s.package").alias("source"), display_name(F.col("s")).alias("target"), nz("s.kind").alias("meta")),
    ]
    return reduce(DataFrame.unionByName, parts).where((nz("source") != "") & (nz("target") != "")).dropDuplicates(["kind", "source", "target", "meta"])


_SECTIONS = (("file_import", "File Imports", "imports"), ("package_import", "Package Imports", "imports"), ("file_owns_symbol", "File Owns Symbols", "owns"), ("package_owns_symbol", "Package Owns Symbols", "owns"))


def relationship_lines(graph: DataFrame) -> DataFrame:
    """(section, seq, line): the graph as sorted lines of Markdown by section; a section without relations says None."""
    order = {k: i for i, (k, _, _) in enumerate(_SECTIONS)}
    verb = F.create_map(*(F.lit(x) for k, _, v in _SECTIONS for x in (k, v)))
    no = F.create_map(*(F.lit(x) for k, i in order.items() for x in (k, i)))
    line = F.concat(F.lit("- `"), "source", F.lit("` "), verb[F.col("kind")], F.lit(" `"), "target", F.lit("`"), F.when(F.col("meta") != "", F.concat(F.lit(" ("), "meta", F.lit(")"))).otherwise(""))
    rows = graph.select(no[F.col("kind")].alias("section"), "source", "target", "meta", line.alias("line"))
    every = graph.sparkSession.createDataFrame([(i,) for i in order.values()], "section int")
    none = every.join(rows.select("section").distinct(), "section", "left_anti").select("section", F.lit("").alias("source"), F.lit("").alias("target"), F.lit("").alias("meta"), F.lit("- None").alias("line"))
    return rows.unionByName(none).select("section", "source", "target", "meta", "line")


# --- entities and relations -----------------------------------------------------------------------------------

ENTITY = ("entity_id", "external_id", "repository_id", "kind", "symbol_kind", "entity_name", "qualified_name", "lang", "file_path", "start_line", "end_line", "start_column", "end_column", "docstring", "signature", "visibility", "exported", "package", "provenance")
_INTS = {"start_line", "end_line", "start_column", "end_column"}


def stable_id(e=F.col) -> Column:
    """Identity of an entity, made of its columns."""
    text = lambda c: nz(e(c))
    first = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c), F.lit(""))
    path = first(text("file_path"), text("entity_name"), text("kind"))
    kind = F.concat(text("kind"), F.when(text("symbol_kind") != "", F.concat(F.lit(":"), text("symbol_kind"))).otherwise(""))
    lines = F.when((F.coalesce(e("start_line"), F.lit(0)) > 0) & (F.coalesce(e("end_line"), F.lit(0)) > 0), F.concat(F.lit("@L"), e("start_line").cast("string"), F.lit("-L"), e("end_line").cast("string"))).otherwise("")
    return F.concat(F.lit("code:"), first(text("repository_id"), F.lit("repo")), F.lit(":"), path, F.lit("#"), kind, F.lit(":"), first(text("qualified_name"), text("entity_name"), path), lines)


def _entity(df: DataFrame, **cols: Column) -> DataFrame:
    def value(c: str) -> Column:
        if c in cols:
            return cols[c]
        return F.lit(0) if c in _INTS else F.lit(False) if c == "exported" else F.lit("")

    named = df.select("*", *(value(c).alias(c) if c not in df.columns else value(c).alias(f"_{c}") for c in ENTITY if c != "entity_id"))
    return named.select(*(F.col(c if c not in df.columns or c == "entity_id" else f"_{c}").alias(c) for c in ENTITY if c != "entity_id")).withColumn("entity_id", stable_id()).select(*ENTITY)


def provenance_ast() -> str:
    return rank.NAMESPACE + "-go-ast"


def summary_provenance() -> Column:
    return F.when((F.col("type") == "go") & (F.size("symbols") > 0), provenance_ast()).otherwise(rank.NAMESPACE + "-regex")


def repository_id(root: str) -> str:
    """Name of a repository's folder without spaces, else a hash of its path."""
    base = posixpath.basename(root.rstrip("/"))
    if base and base != ".":
        return base.strip().replace(" ", "-") or "repo"
    return hashlib.sha1(root.encode()).hexdigest()[:12]  # noqa: S324  an identity, no secret


def _flat(summaries_: DataFrame) -> DataFrame:
    return summaries_.select("repository_id", "path", "type", "imports", "symbols", package_name().alias("pkg"), summary_provenance().alias("prov"))


def file_entity(s: DataFrame) -> DataFrame:
    return _entity(s, repository_id=F.col("repository_id"), kind=F.lit("file"), entity_name=F.col("path"), qualified_name=F.col("path"), lang=F.col("type"), file_path=F.col("path"), provenance=F.col("prov"))


def _symbols(s: DataFrame) -> DataFrame:
    return s.select("repository_id", "path", "type", "pkg", "prov", F.explode("symbols").alias("s"))


def entities(summaries_: DataFrame) -> DataFrame:
    """Repositories, files, packages, imports and symbols, each identity once.

    A package is described by its first file in order of paths.
    """
    s = _flat(summaries_)
    repos = _entity(s.select("repository_id").distinct(), repository_id=F.col("repository_id"), kind=F.lit("repository"), entity_name=F.col("repository_id"), qualified_name=F.col("repository_id"), provenance=F.lit(provenance_ast()))
    first = s.where(nz("pkg") != "").groupBy("repository_id", "pkg").agg(F.min_by(F.struct("type", "prov"), "path").alias("f")).select("repository_id", "pkg", "f.*")
    packages = _entity(first, repository_id=F.col("repository_id"), kind=F.lit("package"), entity_name=F.col("pkg"), qualified_name=F.col("pkg"), lang=F.col("type"), provenance=F.col("prov"))
    imps = s.select("repository_id", "path", "type", "prov", F.explode("imports").alias("imp"))
    import_rows = _entity(imps, repository_id=F.col("repository_id"), kind=F.lit("import"), entity_name=F.col("imp"), qualified_name=F.col("imp"), lang=F.col("type"), file_path=F.col("path"), provenance=F.col("prov"))
    symbol_rows = _symbol_entity(_symbols(s))
    return reduce(DataFrame.unionByName, [repos, file_entity(s), packages, import_rows, symbol_rows]).dropDuplicates(["entity_id"])


def _symbol_entity(sym: DataFrame) -> DataFrame:
    c = F.col
    visibility = F.when(c("s.exported"), "public").otherwise("private")
    return _entity(sym, repository_id=c("repository_id"), kind=F.lit("symbol"), symbol_kind=nz("s.kind"), entity_name=display_name(c("s")), qualified_name=qualified_name(c("s")), lang=c("type"), file_path=c("path"), start_line=c("s.start_line"), end_line=c("s.end_line"), visibility=visibility, exported=c("s.exported"), package=nz("s.package"), provenance=c("prov"))


RELATION = ("source_id", "target_id", "target_ref", "kind", "provenance", "file_path", "line_no")


def relations(summaries_: DataFrame) -> DataFrame:
    """Containment (repository, package and file over files, packages and symbols) and imports, each once."""
    s = _flat(summaries_)

    def identity(kind: str, name: Column, path: Column | None = None, extra: dict | None = None) -> Column:
        cols = {"repository_id": F.col("repository_id"), "kind": F.lit(kind), "entity_name": name, "qualified_name": name, "file_path": F.lit("") if path is None else path, "symbol_kind": F.lit(""), "start_line": F.lit(0), "end_line": F.lit(0)} | (extra or {})
        return stable_id(lambda c: cols[c])

    repo, file = identity("repository", F.col("repository_id")), identity("file", F.col("path"), F.col("path"))
    package = identity("package", F.col("pkg"))
    contains, blank = F.lit("contains"), F.lit("")

    def rows(df: DataFrame, source: Column, target: Column, ref: Column, kind: Column, prov: Column, path: Column, line: Column) -> DataFrame:
        return df.select(source.alias("source_id"), target.alias("target_id"), ref.alias("target_ref"), kind.alias("kind"), prov.alias("provenance"), path.alias("file_path"), line.cast("int").alias("line_no"))

    packaged = s.where(nz("pkg") != "")
    first = packaged.groupBy("repository_id", "pkg").agg(F.min_by("prov", "path").alias("prov"))
    imps = s.select("repository_id", "path", "prov", F.explode("imports").alias("imp"))
    sym = _symbols(s)
    symbol = stable_id(lambda c: {"repository_id": F.col("repository_id"), "kind": F.lit("symbol"), "symbol_kind": nz("s.kind"), "entity_name": display_name(F.col("s")), "qualified_name": qualified_name(F.col("s")), "file_path": F.col("path"), "start_line": F.col("s.start_line"), "end_line": F.col("s.end_line")}[c])
    parts = [
        rows(s, repo, file, blank, contains, F.col("prov"), F.col("path"), F.lit(0)),
        rows(first, repo, package, blank, contains, F.col("prov"), blank, F.lit(0)),
        rows(packaged, package, file, blank, contains, F.col("prov"), F.col("path"), F.lit(0)),
        rows(imps, file, identity("import", F.col("imp"), F.col("path")), F.col("imp"), F.lit("imports"), F.col("prov"), F.col("path"), F.lit(0)),
        rows(sym, file, symbol, blank, contains, F.col("prov"), F.col("path"), F.col("s.start_line")),
        rows(sym.where(nz("pkg") != ""), package, symbol, blank, contains, F.col("prov"), F.col("path"), F.col("s.start_line")),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["kind", "source_id", "target_id", "target_ref", "file_path", "line_no"])


def relation_order() -> list[Column]:
    return [F.asc(c) for c in ("kind", "source_id", "target_id", "target_ref", "file_path", "line_no")]


# --- graphs of other tools ------------------------------------------------------------------------------------

EXTERNAL = "external-graph"


def map_nodes(nodes: DataFrame, provenance: str = EXTERNAL) -> DataFrame:
    """Entities of an external graph's nodes (id, kind, name, qualified_name, language, file_path, lines, columns, docstring, signature, visibility, is_exported, repository_id)."""
    kind = F.when(F.col("kind") == "file", "file").when(F.col("kind").isin("module", "namespace"), "package").otherwise("symbol")
    own = F.when(kind == "symbol", nz("kind")).otherwise("")
    c = F.col
    return _entity(
        nodes, external_id=nz("id"), repository_id=nz("repository_id"), kind=kind, symbol_kind=own, entity_name=nz("name"), qualified_name=nz("qualified_name"), lang=nz("language"), file_path=nz("file_path"),
        start_line=F.coalesce(c("start_line"), F.lit(0)), end_line=F.coalesce(c("end_line"), F.lit(0)), start_column=F.coalesce(c("start_column"), F.lit(0)), end_column=F.coalesce(c("end_column"), F.lit(0)),
        docstring=nz("docstring"), signature=nz("signature"), visibility=nz("visibility"), exported=F.coalesce(c("is_exported"), F.lit(False)), provenance=F.lit(provenance),
    )


def map_edges(edges: DataFrame, entities_: DataFrame, provenance: str = EXTERNAL) -> DataFrame:
    """Relations of an external graph's edges (source, target, kind, line, column, metadata map, provenance).

    An end that no entity has keeps its own id, as source or as ``target_ref``. Of entities with one external id the last by identity counts.
    """
    by_id = entities_.where(nz("external_id") != "").groupBy("external_id").agg(F.max_by(F.struct("entity_id", "file_path"), "entity_id").alias("e")).select("external_id", "e.*")
    src = by_id.select(F.col("external_id").alias("source"), F.col("entity_id").alias("source_entity"), F.col("file_path").alias("source_file"))
    tgt = by_id.select(F.col("external_id").alias("target"), F.col("entity_id").alias("target_entity"))
    pairs = F.transform(F.array_sort(F.map_keys("metadata")), lambda k: F.concat(k, F.lit("="), F.element_at("metadata", k)))
    own = F.when(nz("provenance") != "", F.array(F.concat(F.lit("codegraph_provenance="), "provenance"))).otherwise(F.array().cast("array<string>"))
    joined = edges.join(src, "source", "left").join(tgt, "target", "left")
    return joined.select(
        F.coalesce("source_entity", "source").alias("source_id"), nz("target_entity").alias("target_id"), F.when(F.col("target_entity").isNull(), F.col("target")).otherwise("").alias("target_ref"), "kind",
        F.lit(provenance).alias("provenance"), nz("source_file").alias("file_path"), F.coalesce("line", F.lit(0)).alias("line_no"), F.coalesce("column", F.lit(0)).alias("col_no"),
        F.array_join(F.concat(F.coalesce(pairs, F.array().cast("array<string>")), own), "; ").alias("metadata"),
    )


def map_files(records: DataFrame, provenance: str = EXTERNAL) -> DataFrame:
    """File entities of an external graph's file records (path, content_hash, language, repository_id)."""
    return _entity(records, external_id=nz("content_hash"), repository_id=nz("repository_id"), kind=F.lit("file"), entity_name=nz("path"), qualified_name=nz("path"), lang=nz("language"), file_path=nz("path"), provenance=F.lit(provenance))


# --- concepts and reports -------------------------------------------------------------------------------------


def safe_tag(c: Column) -> Column:
    """Lower case, spaces as hyphens, every other character but letters, digits, hyphens and underscores as an underscore."""
    return F.regexp_replace(F.translate(F.lower(c), " ", "-"), r"[^a-z0-9_\-]", "_")


def concepts_of(summaries_: DataFrame) -> DataFrame:
    """A concept per file with a generated body; optional columns last_commit, last_author, commit_count and modified_at."""
    have = set(summaries_.columns)
    col = lambda c, t, d: F.coalesce(F.col(c).cast(t), F.lit(d)) if c in have else F.lit(d)
    commit, author, commits = col("last_commit", "string", ""), col("last_author", "string", ""), col("commit_count", "int", 0)
    stamp = F.date_format(F.col("modified_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if "modified_at" in have else F.lit("")
    empty = F.array().cast("array<string>")
    c = F.col
    section = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"### {title}\n\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- `"), x, F.lit("`\n"))), ""), F.lit("\n"))).otherwise("")
    symbol_line = lambda s: F.concat(F.lit("- `"), s["kind"], F.lit("` `"), display_name(s), F.lit("` ("), F.when(s["exported"], "exported").otherwise("unexported"), F.lit(") at `"), c("path"), F.lit(":"), s["start_line"].cast("string"), F.lit("-"), s["end_line"].cast("string"), F.lit("`\n"))
    identity = stable_id(lambda k: {"repository_id": c("repository_id"), "kind": F.lit("file"), "entity_name": c("path"), "qualified_name": c("path"), "file_path": c("path"), "symbol_kind": F.lit(""), "start_line": F.lit(0), "end_line": F.lit(0)}[k])
    kind = F.upper("type")
    size, lines = c("size").cast("string"), c("line_count").cast("string")
    body = F.concat(
        F.lit("## File: `"), "path", F.lit("`\n\n## Code Metadata\n\n**Schema Version:** 1\n\n**Entity ID:** `"), identity, F.lit("`\n\n**Generated:** true\n\n## Source\n\n- Path: `"), "path", F.lit("`\n- Language: `"), "type",
        F.lit("`\n- Lines: 1-"), lines, F.lit("\n\n**Type:** "), kind, F.lit("\n\n**Size:** "), size, F.lit(" bytes / "), lines, F.lit(" lines\n\n"),
        F.when(commit != "", F.concat(F.lit("**Last Commit:** `"), commit, F.lit("`\n\n"))).otherwise(""), F.when(author != "", F.concat(F.lit("**Last Modified By:** "), author, F.lit("\n\n"))).otherwise(""),
        F.lit("**Commit Count:** "), commits.cast("string"), F.lit("\n\n**Last Modified:** "), stamp, F.lit("\n\n"),
        F.when(F.size("symbols") > 0, F.concat(F.lit("**Package:** `"), nz(F.try_element_at("symbols", F.lit(1))["package"]), F.lit("`\n\n"))).otherwise(""),
        F.when(F.size("warnings") > 0, F.concat(F.lit("### Parse Warnings\n\n"), F.array_join(F.transform("warnings", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit("\n"))).otherwise(""),
        section("Imports", c("imports")), section("Functions", c("functions")),
        F.when(F.size("symbols") > 0, F.concat(F.lit("### Symbols\n\n"), F.array_join(F.transform("symbols", symbol_line), ""), F.lit("\n"))).otherwise(""),
    )
    tags = F.concat(F.array(F.lit("code"), F.lit("generated"), F.col("type")), F.when(author != "", F.array(safe_tag(author))).otherwise(empty), F.when(commits > 10, F.array(F.lit("frequently-modified"))).otherwise(empty))
    meta = {"generated": F.lit("true"), "generator": F.lit(rank.NAMESPACE + ".git"), "generator_version": F.lit("1"), "source_path": c("path"), "source_kind": F.lit("file"), "source_commit": commit, "language": c("type")}
    custom = F.map_filter(F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v))), lambda _, v: v != "")
    return summaries_.select(
        F.lit("code_file").alias("type"), base_name(c("path")).alias("title"), F.concat(kind, F.lit(" file: "), "path", F.lit(" ("), lines, F.lit(" lines)")).alias("description"),
        F.concat(F.lit(FILE_RESOURCE), "path").alias("resource"), tags.alias("tags"), stamp.alias("timestamp"), body.alias("content"), c("path").alias("file_path"), custom.alias("custom"), "repository_id",
    )


_PACKAGE_LINE = r"\A\*\*Package:\*\* `([^`]*)`\z"
_IMPORT_LINE = r"\A- `([^`]+)`\z"
_SYMBOL = r"\A- `([^`]+)` `([^`]+)` \(([^)]+)\) at `([^`]+)`\z"


def summaries_of(concepts: DataFrame) -> DataFrame:
    """Summaries read back from generated bodies: package, imports and symbols with their lines; rows with neither are dropped."""
    lines = F.transform(F.split("content", "\n"), utrim)
    section = lambda title: F.coalesce(
        F.aggregate(
            "_lines",
            F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("got")),
            lambda acc, x: F.struct(
                F.when(x == f"### {title}", True).when(x.startswith("### "), False).otherwise(acc["on"]).alias("on"),
                F.when(acc["on"] & ~x.startswith("### "), F.concat(acc["got"], F.array(x))).otherwise(acc["got"]).alias("got"),
            ),
            lambda acc: acc["got"],
        ),
        F.array().cast("array<string>"),
    )
    pkg = F.coalesce(F.try_element_at(F.filter(F.transform("_lines", lambda x: F.regexp_extract(x, _PACKAGE_LINE, 1)), lambda x: x != ""), F.lit(1)), F.lit(""))

    def symbol(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, _SYMBOL, k)
        method = (part(1) == "method") & part(2).contains(".")
        place = part(4)
        return F.struct(
            part(1).alias("kind"), F.when(method, F.regexp_replace(part(2), r"\A[^.]*\.", "")).otherwise(part(2)).alias("name"), F.when(method, F.regexp_extract(part(2), r"\A([^.]*)\.", 1)).otherwise("").alias("receiver"),
            F.col("_pkg").alias("package"), (part(3) == "exported").alias("exported"),
            F.coalesce(F.regexp_extract(place, r":(\d+)-\d+\z", 1).try_cast("int"), F.lit(0)).alias("start_line"), F.coalesce(F.regexp_extract(place, r":\d+-(\d+)\z", 1).try_cast("int"), F.lit(0)).alias("end_line"),
        )

    tag = F.try_element_at(F.filter("tags", lambda t: ~t.isin("code", "generated", "frequently-modified")), F.lit(1))
    own = nz(F.try_element_at("custom", F.lit("source_path")))
    path = F.when(own != "", own).when(F.col("resource").startswith(FILE_RESOURCE), F.substring("resource", len(FILE_RESOURCE) + 1, 1 << 30)).otherwise(F.col("resource"))
    derived = F.col("type").isin("code_repository", "code_relation_index", "code_context_view", "deleted")
    got = concepts.where((nz("resource") != "") & ~derived).withColumn("_lines", lines).withColumn("_pkg", pkg)
    out = got.select(
        "repository_id", path.alias("path"), F.when(F.col("type") != "code_file", F.col("type")).otherwise(F.coalesce(tag, F.lit("unknown"))).alias("type"),
        F.filter(F.transform(section("Imports"), lambda x: F.regexp_extract(x, _IMPORT_LINE, 1)), lambda x: x != "").alias("imports"),
        F.transform(F.filter(section("Symbols"), lambda x: x.rlike(_SYMBOL)), symbol).alias("symbols"),
    )
    return out.where((F.size("imports") > 0) | (F.size("symbols") > 0))


def language_counts(summaries_: DataFrame) -> DataFrame:
    return summaries_.groupBy("type").agg(F.count("*").alias("n"))


def symbol_counts(summaries_: DataFrame) -> DataFrame:
    return summaries_.select(F.explode("symbols").alias("s")).groupBy(F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"))


def directory_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """(directory, depth, n): files directly in each directory; the root is ``.``."""
    d = F.when(F.col(path).contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")
    return files.groupBy(d.alias("directory")).agg(F.count("*").alias("n")).withColumn("depth", F.when(F.col("directory") == ".", 0).otherwise(F.length("directory") - F.length(F.translate("directory", "/", ""))).cast("int"))


def top_authors(author_files: DataFrame, n: int = 10) -> DataFrame:
    """The authors with the most files, ties by name, with their share of all in per cent."""
    total = author_files.agg(F.sum("n").alias("total"))
    shared = author_files.crossJoin(F.broadcast(total)).select("author", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))  # one row
    best = shared.orderBy(F.desc("n"), F.asc("author")).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("author"))))


def commit_metadata(changes: DataFrame) -> DataFrame:
    """(path, last_commit, last_author, commit_count) from rows (path, hash, author, at): of the newest commit, ties by hash."""
    return changes.groupBy("path").agg(F.max_by("hash", F.struct("at", "hash")).alias("last_commit"), F.max_by("author", F.struct("at", "hash")).alias("last_author"), F.count("*").alias("commit_count"))


def include_files(files: DataFrame, include: list[str], exclude_dirs: list[str], max_kb: int) -> DataFrame:
    """Files whose path or name matches a glob, not below an excluded top-level directory, not above the size (unknown sizes pass)."""
    from marrow.functions.text import simple_glob_matches

    path = F.col("path")
    outside = reduce(lambda a, d: a & ~(path.startswith(d + "/") | (path == d)), exclude_dirs, F.lit(True))
    wanted = reduce(lambda a, g: a | simple_glob_matches(path, g), include, F.lit(False)) if include else F.lit(True)
    return files.where(outside & wanted & (F.col("size").isNull() | (F.col("size") <= max_kb * 1024)))


# --- reports --------------------------------------------------------------------------------------------------------
# A report is a DataFrame of lines (part, key columns, line). Long ones (all relations) stay lines, to be written by the
# executors; others are gathered into concepts of a bounded number of lines.


def _counts_section(part: int, counts: DataFrame, key: str) -> DataFrame:
    return counts.select(F.lit(part).alias("part"), F.col(key).alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("- **"), key, F.lit(":** "), F.col("n").cast("string")).alias("line"))


def _heads(spark, rows: list[tuple[int, str]]) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([(p, "", "", t) for p, t in rows], "part int, k1 string, k2 string, line string")


def repository_report(summaries_: DataFrame, n_entities: int, n_relations: int, repository: str) -> DataFrame:
    """Files, entities and relations of a repository, its languages and kinds of symbols, and the files written."""
    n_files = summaries_.count()
    head = [
        (0, f"## Code Repository\n\n**Repository:** `{repository}`\n\n**Repository ID:** `{repository_id(repository)}`\n"),
        (1, f"**Indexed Files:** {n_files}\n\n**Code Entities:** {n_entities}\n\n**Code Relations:** {n_relations}\n"),
        (2, "### Language Distribution\n"), (4, "\n### Symbol Counts\n"), (6, "\n### Generated Artifacts\n\n- `project/code_repository.md`\n- `project/code_relations.md`"),
    ]
    files = summaries_.select(F.lit(7).alias("part"), F.col("path").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("- `"), "path", F.lit(".md`")).alias("line"))
    return reduce(DataFrame.unionByName, [_heads(summaries_.sparkSession, head), _counts_section(3, language_counts(summaries_), "type"), _counts_section(5, symbol_counts(summaries_), "kind"), files])


def relation_index_report(relations_: DataFrame) -> DataFrame:
    """A table row per relation, in the order of relations; two leading lines, as other readers expect them."""
    target = F.when(nz("target_id") != "", F.col("target_id")).otherwise(nz("target_ref"))
    place = F.when(F.coalesce("line_no", F.lit(0)) > 0, F.concat("file_path", F.lit(":"), F.col("line_no").cast("string"))).otherwise(nz("file_path"))
    line = F.concat(F.lit("| "), "kind", F.lit(" | `"), "source_id", F.lit("` | `"), target, F.lit("` | `"), place, F.lit("` | "), nz("provenance"), F.lit(" |"))
    rows = relations_.select(F.lit(1).alias("part"), F.concat_ws("\u0000", "kind", "source_id").alias("k1"), F.concat_ws("\u0000", "target_id", "target_ref", "file_path", F.lpad(F.col("line_no").cast("string"), 10, "0")).alias("k2"), line.alias("line"))
    return _heads(relations_.sparkSession, [(0, "| Kind | Source | Target | Location | Provenance |\n| --- | --- | --- | --- | --- |")]).unionByName(rows)


def structure_report(files: DataFrame, path: str = "path") -> DataFrame:
    """Folders with their number of files, indented by depth."""
    d = directory_counts(files, path)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- `"), "directory", F.lit("/` ("), F.col("n").cast("string"), F.lit(" files)"))
    return _heads(files.sparkSession, [(0, "## Directory Structure\n")]).unionByName(d.select(F.lit(1).alias("part"), F.col("directory").alias("k1"), F.lit("").alias("k2"), line.alias("line")))


def contributors_report(author_files: DataFrame) -> DataFrame:
    """All authors by files, ties by name, with their share."""
    t = author_files.agg(F.count("*").alias("people"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    w = rank.numbered(author_files.orderBy(F.desc("n"), F.asc("author")), "rank").crossJoin(F.broadcast(t))  # one row
    line = F.concat(F.col("rank").cast("string"), F.lit(". **"), "author", F.lit("** - "), F.col("n").cast("string"), F.lit(" files ("), F.format_number(F.round(F.col("n") * 100.0 / F.col("total"), 1), 1), F.lit("%)"))
    head = t.select(F.lit(0).alias("part"), F.lit("").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("## Contributors\n\n**Total Contributors:** "), F.col("people").cast("string"), F.lit("\n\n**Total File Ownership:** "), F.col("total").cast("string"), F.lit(" entries\n\n### Top Contributors\n")).alias("line"))
    return head.unionByName(w.select(F.lit(1).alias("part"), F.lpad(F.col("rank").cast("string"), 12, "0").alias("k1"), F.lit("").alias("k2"), line.alias("line")))


def overview_report(files: DataFrame, author_files: DataFrame, project: str, branch: str = "", commit: str = "") -> DataFrame:
    """Name, branch, commit, types of files and the ten authors with the most files."""
    types = files.select(file_type(F.col("path")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    total = files.agg(F.count("*").alias("n")).select(F.lit(1).alias("part"), F.lit("").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("**Total Files:** "), F.col("n").cast("string"), F.lit("\n")).alias("line"))
    head = [(0, f"## Project: `{project}`\n\n**Branch:** `{branch}`\n" + (f"\n**Current Commit:** `{commit[:12]}`\n" if commit else "")), (2, "### File Types\n"), (4, "\n### Top Contributors\n")]
    kinds = types.select(F.lit(3).alias("part"), F.col("type").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("- **"), "type", F.lit(":** "), F.col("n").cast("string"), F.lit(" files")).alias("line"))
    best = top_authors(author_files).select(F.lit(5).alias("part"), F.lpad(F.col("rank").cast("string"), 3, "0").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("- "), "author", F.lit(" ("), F.col("n").cast("string"), F.lit(" files)")).alias("line"))
    return reduce(DataFrame.unionByName, [_heads(files.sparkSession, head), total, kinds, best])


#: Lines of a report that one concept holds.
LINES_OF_CONCEPT = 50_000


def as_concept(lines: DataFrame, type_: str, title: str, path: str, description: str = "", tags: tuple[str, ...] = ()) -> DataFrame:
    """A report as a concept; one of more than ``LINES_OF_CONCEPT`` lines goes on in further ones, ``path`` with ``.2`` and so on before its ending."""
    placed = rank.numbered(lines.select("part", "k1", "k2", "line").orderBy("part", "k1", "k2", "line"), "n")
    chapter = F.floor((F.col("n") - 1) / LINES_OF_CONCEPT) + 1
    body = placed.groupBy(chapter.cast("int").alias("_c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"))
    stem, dot, ending = path.rpartition(".")
    own = F.when(F.col("_c") == 1, path).otherwise(F.concat(F.lit(stem or path), F.lit("."), F.col("_c").cast("string"), F.lit(dot + ending if stem else "")))
    return body.select(F.lit(type_).alias("type"), F.lit(title).alias("title"), F.lit(description).alias("description"), F.lit("").alias("resource"), F.array(*(F.lit(t) for t in tags)).cast("array<string>").alias("tags"), F.lit("").alias("timestamp"), F.concat("content", F.lit("\n")).alias("content"), own.alias("file_path"), F.create_map().cast("map<string,string>").alias("custom"))
