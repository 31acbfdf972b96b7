"""Queries on code analysis, the code graph, change detection, merging and upserts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions.text import clean_path, glob_matches, nz
from marrow.operators import changes, codegraph, rank
from marrow.plans.tables import ENTITIES, KB, concepts, entities, once, table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").select("source_id", nz("repository_id").alias("repository_id"), nz("file_path").alias("path"), F.col("size_bytes").alias("size"), nz("content").alias("content"), F.col("modified_at").cast("timestamp").alias("modified_at"))


def entity_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of files as their indexed entities tell them."""
    e = entities(spark, sf_dir).where(F.col("kind").isin("symbol", "import"))
    symbol = F.struct(nz("symbol_kind").alias("kind"), nz("entity_name").alias("name"), F.lit("").alias("receiver"), nz("package").alias("package"), F.coalesce("exported", F.lit(False)).alias("exported"), F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"))
    return (
        e.groupBy(nz("repository_id").alias("repository_id"), nz("file_path").alias("path"))
        .agg(
            F.max(nz("lang")).alias("type"),
            F.array_sort(F.collect_set(F.when(F.col("kind") == "import", F.col("entity_name")))).alias("imports"),
            F.array_sort(F.collect_set(F.when(F.col("kind") == "symbol", symbol))).alias("symbols"),
        )
        .withColumn("size", F.lit(0).cast("long"))
    )


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select(codegraph.file_type(F.col("path")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def imports_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("source_id", F.explode(codegraph.imports(F.col("content"), codegraph.file_type(F.col("path")))).alias("name"))


def functions_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("source_id", F.explode(codegraph.functions(F.col("content"), codegraph.file_type(F.col("path")))).alias("name"))


def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = codegraph.summaries(files(spark, sf_dir))
    return s.select("repository_id", "path", "type", "size", "line_count", F.size("imports").alias("n_imports"), F.size("functions").alias("n_functions"), F.size("symbols").alias("n_symbols"), F.size("warnings").alias("n_warnings"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("source_id", codegraph.line_count(F.col("content")).alias("line_count"))


def go_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = codegraph.summaries(files(spark, sf_dir))
    return s.select("repository_id", "path", F.explode("symbols").alias("s")).select("repository_id", "path", "s.*")


def file_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.concepts_of(codegraph.summaries(files(spark, sf_dir))).select("repository_id", "file_path", "title", "description", "resource", F.length("content").alias("n_content"))


def summaries_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated bodies read back: symbols with their lines survive the round trip."""
    back = codegraph.summaries_of(codegraph.concepts_of(codegraph.summaries(files(spark, sf_dir))))
    return back.select("repository_id", "path", "type", F.size("imports").alias("n_imports"), F.size("symbols").alias("n_symbols"))


def relationship_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.relationship_graph(entity_summaries(spark, sf_dir))


def relationship_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.relationship_lines(codegraph.relationship_graph(entity_summaries(spark, sf_dir))).select("section", "line")


def code_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.entities(entity_summaries(spark, sf_dir)).select("entity_id", "kind", "lang", "provenance")


def code_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.relations(entity_summaries(spark, sf_dir)).select("source_id", "target_id", "target_ref", "kind", "file_path", "line_no")


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.language_counts(entity_summaries(spark, sf_dir))


def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.symbol_counts(entity_summaries(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).where(nz("external_id") != "")
    kind = F.when(nz("symbol_kind") != "", F.col("symbol_kind")).when(F.col("kind") == "package", "module").otherwise(F.col("kind"))
    return e.select(F.col("external_id").alias("id"), kind.alias("kind"), F.col("entity_name").alias("name"), "qualified_name", F.col("lang").alias("language"), "file_path", "start_line", "end_line", "start_column", "end_column", "docstring", "signature", "visibility", F.col("exported").alias("is_exported"), "repository_id")


def map_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.map_nodes(_nodes(spark, sf_dir)).select("entity_id", "external_id", "kind", "symbol_kind", "provenance")


def map_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = codegraph.map_nodes(_nodes(spark, sf_dir))
    own = entities(spark, sf_dir).where(nz("external_id") != "").select(F.col("entity_id").alias("source_entity_id"), F.col("external_id").alias("_ext"))
    r = table(spark, sf_dir, "code_relations").dropDuplicates(["relation_id"]).where(nz("target_ref") != "").join(own, "source_entity_id", "left")
    edges = r.select(
        "relation_id", F.coalesce("_ext", "source_entity_id").alias("source"), F.col("target_ref").alias("target"), nz("kind").alias("kind"), F.col("line_no").alias("line"), F.col("col_no").alias("column"),
        F.when(nz("metadata") != "", F.str_to_map("metadata", F.lit("; "), F.lit("="))).alias("metadata"), "provenance",
    )
    return codegraph.map_edges(edges, nodes).select("source_id", "target_id", "target_ref", "kind", "file_path", "line_no", "col_no", "metadata")


def map_graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("path", F.sha2("content", 256).alias("content_hash"), codegraph.file_type(F.col("path")).alias("language"), "repository_id")
    return codegraph.map_files(f).select("entity_id", "external_id", "lang")


def git_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("hash"), F.col("event_type").alias("author"), F.col("ts").alias("at"))
    return codegraph.commit_metadata(e)


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author")).agg(F.count("*").alias("n"))


def authors_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.top_authors(_authors(spark, sf_dir)).select("rank", "author", "n", "percent")


def dir_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.directory_counts(files(spark, sf_dir))


def include_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.include_files(files(spark, sf_dir), ["*.go", "*.[jt]s", "se?l.py"], ["harbor", "alder"], 4).select("source_id", "path")


def relation_index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.relation_index_report(codegraph.relations(entity_summaries(spark, sf_dir))).where("part = 1").select("line")


def structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.structure_report(files(spark, sf_dir)).where("part = 1").select("line")


def contributors_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.contributors_report(_authors(spark, sf_dir)).where("part = 1").select("line")


def report_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded reports as concepts."""
    f, a, s = files(spark, sf_dir), _authors(spark, sf_dir), entity_summaries(spark, sf_dir)
    made = [
        codegraph.as_concept(codegraph.overview_report(f, a, "demo", "main", "0123456789abcdef"), "project", "Project Overview", "project/project_overview.md", tags=("project",)),
        codegraph.as_concept(codegraph.repository_report(s, codegraph.entities(s).count(), codegraph.relations(s).count(), "demo"), "code_repository", "Code Repository", "project/code_repository.md", tags=("code", "repository", "generated")),
    ]
    return made[0].unionByName(made[1]).select("type", "title", "file_path", F.length("content").alias("n_content"))


GLOBS = ("**/*.go", "harbor/**", "*/*/*.py", "**/sea*/**/*.ts", "**.rs", "[a-f]*/**", "**")


def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    rows = [f.select("source_id", F.lit(i).alias("pattern_no")).where(glob_matches(F.col("path"), g)) for i, g in enumerate(GLOBS)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def path_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("source_id", clean_path(F.concat(F.lit("./x/../"), "path", F.lit("//"))).alias("path"))


def _listing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files now, their contents, and an index of an earlier state: some were not tracked, some had other contents, some are gone."""
    f = files(spark, sf_dir).withColumn("source_path", F.col("source_id").cast("string"))
    now = f.where(F.col("repository_id") != "knoll-notes")
    was = f.where(~F.col("repository_id").startswith("b"))
    changed, touched = F.col("repository_id") < "e", F.col("repository_id") < "p"
    index = was.select(
        "source_path", F.concat(F.lit("kb/"), "source_path").alias("target_path"), F.when(changed, F.sha2(F.concat("content", F.lit("old")), 256)).otherwise(F.sha2("content", 256)).alias("content_hash"),
        F.when(touched, F.col("modified_at") - F.expr("interval 1 hour")).otherwise(F.col("modified_at")).alias("last_modified"), F.col("modified_at").alias("last_imported"), F.col("size").alias("file_size"),
        F.when(F.col("repository_id") < "c", "merge").otherwise("").alias("strategy"), F.array().cast("array<string>").alias("patch_fields"), F.lit(True).alias("source_exists"),
    )
    return now.select("source_path", "size", F.col("modified_at").alias("mtime")), now.select("source_path", "content"), index


def detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.detect(*_listing(spark, sf_dir)).select("source_path", "result", "new_hash")


def detect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.counters(changes.detect(*_listing(spark, sf_dir)))


def index_after_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing, contents, index = _listing(spark, sf_dir)
    detected = changes.detect(listing, contents, index)
    got = changes.updated_index(index, detected, F.lit("2026-06-01").cast("timestamp"), F.concat(F.lit("kb/"), "source_path"))
    return changes.prune_missing(got, detected).select("source_path", "target_path", "content_hash", "strategy", "source_exists")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = once(concepts(spark, sf_dir).select("ord", "type", "repository_id"))
    o = F.col("ord").cast("string")
    source = F.concat(F.lit("---\nowner: '"), "repository_id", F.lit("'\ntags:\n  - a"), o, F.lit("\n  - shared\ntitle: \"S"), o, F.lit("\"\n---\n\nsource body"))
    target = F.concat(F.lit("---\ntitle: T"), o, F.lit("\ndescription: D: x\ntags:\n- shared\n- b\n---\nbody "), o)
    strategy = F.when(F.col("type") == "code_file", "merge").when(F.col("type") == "code_symbol", "patch").when(F.col("type") == "api", "overwrite").otherwise("")
    return c.select("ord", source.alias("source"), F.when(nz("type") != "guide", target).alias("target"), strategy.alias("strategy"), F.array().cast("array<string>").alias("patch_fields"))


def merge_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.apply_strategies(_pairs(spark, sf_dir)).select("ord", "used", "changed", "result")


def upsert_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code file comes again with another title, and a tombstone for every metric."""
    c = once(concepts(spark, sf_dir).select("ord", "type", "title", "resource", "file_path"))
    again = c.where(F.col("type") == "code_file").withColumn("title", F.concat(F.lit("new "), "title"))
    dead = c.where((F.col("type") == "metric") & (F.col("resource") != "")).withColumn("type", F.lit("deleted"))
    return changes.upsert(c, again.unionByName(dead)).select("ord", "title")


def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package of each file, and by what its entities are known."""
    return entity_summaries(spark, sf_dir).select("repository_id", "path", codegraph.package_name().alias("package"), codegraph.summary_provenance().alias("provenance"))


def symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of Go symbols as they are shown, alone and with their package."""
    s = codegraph.summaries(files(spark, sf_dir)).select("repository_id", "path", F.explode("symbols").alias("s"))
    return s.select("repository_id", "path", F.col("s.start_line").alias("start_line"), codegraph.display_name(F.col("s")).alias("shown"), codegraph.qualified_name(F.col("s")).alias("qualified"))


def relations_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations with their places in the order of relations."""
    r = codegraph.relations(entity_summaries(spark, sf_dir)).select("kind", "source_id", "target_id", "target_ref", "file_path", "line_no")
    return rank.numbered(r.orderBy(*codegraph.relation_order()), "place")


def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of repositories by the folders where they lie."""
    roots = [r[0] for r in table(spark, sf_dir, "repositories").select("repository_id").collect()]  # of fixed size
    return spark.createDataFrame([(r, codegraph.repository_id(r)) for r in [*(f"/srv/my {r}/" for r in roots), "/", "."]], "root string, name string")


QUERIES = {f.__name__: f for f in (
    package_names, symbol_names, relations_ordered, repository_names,
    file_types, imports_extract, functions_extract, file_summaries, line_counts, go_symbols, file_concepts, summaries_read_back, relationship_graph, relationship_lines, code_entities, code_relations,
    language_counts, symbol_counts, map_graph_nodes, map_graph_edges, map_graph_files, git_metadata, authors_top10, dir_tree, relation_index_report, structure_report, contributors_report, report_concepts, include_files, glob_match, path_clean, detect_changes, detect_counts,
    index_after_import, merge_strategies, upsert_incremental,
)}

_TYPE = "CASE lower(regexp_extract(file_path, '\\.([^./]*)$', 1)) WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'rb' THEN 'ruby' ELSE lower(regexp_extract(file_path, '\\.([^./]*)$', 1)) END"
_FILES = f"WITH f AS (SELECT source_id, coalesce(repository_id, '') AS repository_id, coalesce(file_path, '') AS path, size_bytes AS size, coalesce(content, '') AS content, modified_at, {_TYPE} AS type FROM source_files)"


def _lines_sql(patterns: dict[str, list[str]], extra: str = "") -> str:
    tests = " UNION ".join(f"SELECT source_id, trim(regexp_extract(l, '{p.replace(chr(39), chr(39) * 2)}', 1), chr(9) || chr(10) || chr(13) || ' ') AS name FROM line WHERE type = '{t}'" for t, ps in patterns.items() for p in ps)
    return f"{_FILES}, line AS (SELECT source_id, type, unnest(string_split(content, chr(10))) AS l FROM f) SELECT source_id, name FROM ({tests}) WHERE name <> '' {extra}"


_SUMMARY = ENTITIES + """
, part AS (SELECT coalesce(repository_id, '') AS repo, coalesce(file_path, '') AS path, coalesce(lang, '') AS lang, * EXCLUDE (repository_id, file_path, lang) FROM ent WHERE kind IN ('symbol', 'import')),
f0 AS (SELECT repo, path, max(lang) AS type, count(*) FILTER (kind = 'symbol') AS n_symbols FROM part GROUP BY 1, 2),
imp AS (SELECT DISTINCT repo, path, entity_name AS target FROM part WHERE kind = 'import'),
s0 AS (SELECT DISTINCT repo, path, coalesce(symbol_kind, '') AS kind, coalesce(entity_name, '') AS name, coalesce(package, '') AS package, coalesce(exported, false) AS exported, coalesce(start_line, 0) AS a, coalesce(end_line, 0) AS b FROM part WHERE kind = 'symbol'),
pkg AS (SELECT repo, path, arg_min(package, (kind, name, package, exported, a, b)) AS p FROM s0 WHERE package <> '' GROUP BY 1, 2),
f AS (SELECT f0.*, coalesce(pkg.p, f0.type) AS pkg, CASE WHEN type = 'go' AND n_symbols > 0 THEN 'kb-go-ast' ELSE 'kb-regex' END AS prov FROM f0 LEFT JOIN pkg USING (repo, path)),
s AS (SELECT s0.*, CASE WHEN package <> '' THEN package || '.' || name ELSE name END AS qname FROM s0)
"""
_GRAPH = _SUMMARY + """
, g AS (
  SELECT 'file_import' AS kind, path AS source, target, '' AS meta FROM imp
  UNION SELECT 'package_import', pkg, target, '' FROM imp JOIN f USING (repo, path)
  UNION SELECT 'file_owns_symbol', path, qname, kind FROM s
  UNION SELECT 'package_owns_symbol', package, name, kind FROM s
), graph AS (SELECT * FROM g WHERE coalesce(source, '') <> '' AND coalesce(target, '') <> '')
"""
_IDS = _SUMMARY + """
, sid AS (SELECT *, 'code:' || CASE WHEN repo = '' THEN 'repo' ELSE repo END || ':' || CASE WHEN path <> '' THEN path WHEN name <> '' THEN name ELSE 'symbol' END || '#symbol' || CASE WHEN kind <> '' THEN ':' || kind ELSE '' END || ':' || qname
    || CASE WHEN a > 0 AND b > 0 THEN '@L' || a || '-L' || b ELSE '' END AS id FROM s),
fid AS (SELECT *, 'code:' || repo || ':' || path || '#file:' || path AS id, 'code:' || repo || ':' || repo || '#repository:' || repo AS rid, 'code:' || repo || ':' || pkg || '#package:' || pkg AS pid FROM f),
iid AS (SELECT *, 'code:' || repo || ':' || path || '#import:' || target AS id FROM imp)
"""
_NODES = ENTITIES + """
, node AS (SELECT coalesce(repository_id, '') AS repo, external_id, CASE WHEN coalesce(symbol_kind, '') <> '' THEN symbol_kind WHEN kind = 'package' THEN 'module' ELSE kind END AS nk, coalesce(entity_name, '') AS name, coalesce(qualified_name, '') AS q,
  coalesce(file_path, '') AS path, coalesce(start_line, 0) AS a, coalesce(end_line, 0) AS b FROM ent WHERE coalesce(external_id, '') <> ''),
typed AS (SELECT *, CASE WHEN nk = 'file' THEN 'file' WHEN nk IN ('module', 'namespace') THEN 'package' ELSE 'symbol' END AS kind FROM node),
mapped AS (SELECT *, CASE WHEN kind = 'symbol' THEN nk ELSE '' END AS sk, 'code:' || CASE WHEN repo = '' THEN 'repo' ELSE repo END || ':' || CASE WHEN path <> '' THEN path WHEN name <> '' THEN name ELSE kind END || '#' || kind
  || CASE WHEN kind = 'symbol' THEN ':' || nk ELSE '' END || ':' || CASE WHEN q <> '' THEN q WHEN name <> '' THEN name ELSE path END || CASE WHEN a > 0 AND b > 0 THEN '@L' || a || '-L' || b ELSE '' END AS id FROM typed)
"""
_DETECT = _FILES + """
, idx AS (SELECT source_id::VARCHAR AS source_path, CASE WHEN repository_id < 'e' THEN sha256(content || 'old') ELSE sha256(content) END AS h, CASE WHEN repository_id < 'p' THEN modified_at - INTERVAL 1 HOUR ELSE modified_at END AS m, size AS n,
  CASE WHEN repository_id < 'c' THEN 'merge' ELSE '' END AS strategy FROM f WHERE NOT starts_with(repository_id, 'b')),
now AS (SELECT source_id::VARCHAR AS source_path, size, modified_at, sha256(content) AS h2 FROM f WHERE repository_id <> 'knoll-notes'),
d AS (SELECT coalesce(now.source_path, idx.source_path) AS source_path, CASE WHEN now.source_path IS NULL THEN 'source_missing' WHEN idx.source_path IS NULL THEN 'new_file' WHEN size = n AND abs(epoch(modified_at) - epoch(m)) < 1 THEN 'no_change'
  WHEN h = h2 THEN 'meta_changed' ELSE 'content_changed' END AS result, h, h2, strategy, idx.source_path IS NOT NULL AS tracked FROM now FULL JOIN idx ON now.source_path = idx.source_path)
"""

# Go as SQL reads it: comments and literals blanked out line by line, declarations at the beginnings of lines, ends at closing brackets there.
_BETWEEN = r"""//[^\n]*|/\*(?s:.)*?\*/|`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
_BLANKED = "array_to_string(list_transform(range(1, len(seg) + 1), lambda i: seg[i] || CASE WHEN i > len(tok) THEN '' WHEN {keep} THEN tok[i] ELSE repeat(chr(10), len(tok[i]) - len(replace(tok[i], chr(10), ''))) END), '')"
_GO = _FILES + f"""
, lexed AS (SELECT source_id, repository_id, path, string_split_regex(ltrim(content, chr(65279)), '{_BETWEEN.replace("'", "''")}') AS seg, regexp_extract_all(ltrim(content, chr(65279)), '{_BETWEEN.replace("'", "''")}') AS tok FROM f WHERE type = 'go' AND content <> ''),
blanked AS (SELECT source_id, repository_id, path, replace({_BLANKED.format(keep="false")}, chr(13), '') AS code, {_BLANKED.format(keep="NOT starts_with(tok[i], '/')")} AS lit FROM lexed),
gl AS (SELECT source_id, repository_id, path, unnest(string_split(code, chr(10))) AS l, unnest(range(1, len(string_split(code, chr(10))) + 1)) AS i FROM blanked),
pkg0 AS (SELECT source_id, min_by(regexp_extract(l, '^package +(\\w+)', 1), i) AS package FROM gl WHERE regexp_matches(l, '^package +\\w') GROUP BY 1),
decl AS (SELECT *, regexp_extract(l, '^func\\s*\\(([^)]*)\\)', 1) AS recv, CASE WHEN starts_with(l, 'func') THEN regexp_extract(l, '^func\\s*(?:\\([^)]*\\))?\\s*([\\pL_]\\w*)', 1) ELSE regexp_extract(l, '^type\\s+([\\pL_]\\w*)', 1) END AS name,
  len(l) - len(replace(l, '{{', '')) = len(l) - len(replace(l, '}}', '')) AND len(l) - len(replace(l, '(', '')) = len(l) - len(replace(l, ')', '')) AS closed FROM gl WHERE regexp_matches(l, '^(func|type)\\b')),
ends AS (SELECT d.source_id, d.i, min(e.i) AS j FROM decl d JOIN gl e ON d.source_id = e.source_id AND e.i > d.i AND regexp_matches(e.l, '^[}})]\\s*$') GROUP BY 1, 2),
go AS (SELECT d.source_id, repository_id, path, d.i AS start_line, (CASE WHEN closed THEN d.i ELSE j END) AS end_line, name, package,
  CASE WHEN recv = '' THEN '' ELSE regexp_extract(regexp_replace(recv, '\\[.*$', ''), '([\\pL_]\\w*)[^\\w]*$', 1) END AS receiver, contains(recv, '*') AS pointer,
  CASE WHEN recv <> '' THEN 'method' WHEN starts_with(l, 'func') THEN 'function' WHEN regexp_matches(l, '^type\\s+\\w+\\s*(\\[[^\\]]+\\])?\\s*=?\\s*struct\\b') THEN 'struct' WHEN regexp_matches(l, '^type\\s+\\w+\\s*(\\[[^\\]]+\\])?\\s*=?\\s*interface\\b') THEN 'interface' ELSE 'type' END AS kind
  FROM decl d JOIN pkg0 USING (source_id) LEFT JOIN ends USING (source_id, i)),
gonames AS (SELECT DISTINCT source_id, CASE kind WHEN 'method' THEN CASE WHEN pointer THEN '(*' || receiver || ').' ELSE receiver || '.' END || name WHEN 'function' THEN name ELSE kind || ' ' || name END AS name FROM go),
goimp AS (SELECT DISTINCT source_id, unnest(list_transform(regexp_extract_all(h, '"([^"\\n]+)"|`([^`\\n]+)`'), lambda x: trim(x, '"`'))) AS name FROM (SELECT source_id, regexp_extract(lit, '(?s)^(.*?)(?:\\n(?:func|type|var|const)\\b|$)', 1) AS h FROM blanked))
"""


def _found_sql(patterns: dict[str, list[str]], extra: str = "") -> str:
    tests = " UNION ".join(f"SELECT source_id, trim(regexp_extract(l, '{p.replace(chr(39), chr(39) * 2)}', 1), chr(9) || chr(10) || chr(13) || ' ') AS name FROM line WHERE type = '{t}'" for t, ps in patterns.items() if t != "go" for p in ps)
    return f"SELECT source_id, name FROM ({tests}) WHERE name <> '' {extra}"


_SUMMARIES = _GO + f""", line AS (SELECT source_id, type, unnest(string_split(content, chr(10))) AS l FROM f),
imps AS ({_found_sql(codegraph.IMPORTS)} UNION SELECT source_id, name FROM goimp), fns AS ({_found_sql(codegraph.FUNCTIONS, "AND strlen(name) < 80")} UNION SELECT source_id, name FROM gonames),
warned AS (SELECT source_id FROM f WHERE type = 'go' AND (content = '' OR source_id NOT IN (SELECT source_id FROM pkg0))),
summary AS (SELECT f.*, CASE WHEN content = '' THEN 0 ELSE len(content) - len(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END AS line_count,
  (SELECT count(*) FROM imps WHERE imps.source_id = f.source_id) AS n_imports, (SELECT count(*) FROM fns WHERE fns.source_id = f.source_id) AS n_functions, (SELECT count(*) FROM go WHERE go.source_id = f.source_id) AS n_symbols,
  CASE WHEN source_id IN (SELECT source_id FROM warned) THEN 1 ELSE 0 END AS n_warnings FROM f)
"""

SQL = {
    "package_names": _SUMMARY + "SELECT repo AS repository_id, path, pkg AS package, prov AS provenance FROM f",
    "symbol_names": _GO + ", d AS (SELECT *, CASE WHEN receiver <> '' THEN receiver || '.' || name ELSE name END AS shown FROM go) SELECT repository_id, path, start_line, shown, package || '.' || shown AS qualified FROM d",
    "relations_ordered": _IDS + """, r AS (
  SELECT rid AS source_id, id AS target_id, '' AS target_ref, 'contains' AS kind, path AS file_path, 0 AS line_no FROM fid
  UNION SELECT rid, pid, '', 'contains', '', 0 FROM fid WHERE pkg <> '' UNION SELECT pid, id, '', 'contains', path, 0 FROM fid WHERE pkg <> ''
  UNION SELECT fid.id, iid.id, target, 'imports', path, 0 FROM fid JOIN iid USING (repo, path)
  UNION SELECT fid.id, sid.id, '', 'contains', path, a FROM fid JOIN sid USING (repo, path) UNION SELECT pid, sid.id, '', 'contains', path, a FROM fid JOIN sid USING (repo, path) WHERE pkg <> '')
SELECT *, row_number() OVER (ORDER BY kind, source_id, target_id, target_ref, file_path, line_no) AS place FROM r""",
    "repository_names": "SELECT '/srv/my ' || repository_id || '/' AS root, 'my-' || repository_id AS name FROM repositories UNION ALL SELECT r, left(sha1(r), 12) FROM (VALUES ('/'), ('.')) AS t(r)",
    "file_types": _FILES + " SELECT type, count(*) AS n FROM f GROUP BY type",
    "imports_extract": _lines_sql(codegraph.IMPORTS),
    "functions_extract": _lines_sql(codegraph.FUNCTIONS, "AND strlen(name) < 80"),
    "go_symbols": _GO + "SELECT repository_id, path, kind, name, receiver, package, regexp_matches(name, '^\\p{Lu}') AS exported, start_line, end_line FROM go",
    "file_summaries": _SUMMARIES + "SELECT repository_id, path, type, coalesce(size, strlen(content)) AS size, line_count, n_imports, n_functions, n_symbols, n_warnings FROM summary",
    "file_concepts": _SUMMARIES + r"""
, own AS (SELECT *, CASE WHEN repository_id = '' THEN 'repo' ELSE repository_id END AS repo, CASE WHEN path = '' THEN 'file' ELSE path END AS named, coalesce(size, strlen(content)) AS bytes, chr(10) AS n FROM summary),
lists AS (SELECT own.*, (SELECT string_agg('- `' || name || '`' || chr(10), '') FROM imps WHERE imps.source_id = own.source_id) AS i, (SELECT string_agg('- `' || name || '`' || chr(10), '') FROM fns WHERE fns.source_id = own.source_id) AS g,
  (SELECT string_agg('- `' || kind || '` `' || CASE WHEN receiver <> '' THEN receiver || '.' ELSE '' END || name || '` (' || CASE WHEN regexp_matches(name, '^\p{Lu}') THEN 'exported' ELSE 'unexported' END || ') at `' || go.path || ':' || start_line || '-' || end_line || '`' || chr(10), '') FROM go WHERE go.source_id = own.source_id) AS y,
  (SELECT any_value(package) FROM go WHERE go.source_id = own.source_id) AS package FROM own),
body AS (SELECT *, '## File: `' || path || '`' || n || n || '## Code Metadata' || n || n || '**Schema Version:** 1' || n || n || '**Entity ID:** `code:' || repo || ':' || named || '#file:' || named || '`' || n || n || '**Generated:** true' || n || n
  || '## Source' || n || n || '- Path: `' || path || '`' || n || '- Language: `' || type || '`' || n || '- Lines: 1-' || line_count || n || n || '**Type:** ' || upper(type) || n || n || '**Size:** ' || bytes || ' bytes / ' || line_count || ' lines' || n || n
  || '**Commit Count:** 0' || n || n || '**Last Modified:** ' || n || n || CASE WHEN n_symbols > 0 THEN '**Package:** `' || package || '`' || n || n ELSE '' END
  || CASE WHEN n_warnings > 0 THEN '### Parse Warnings' || n || n || '- failed to parse Go: no package clause' || n || n ELSE '' END
  || coalesce('### Imports' || n || n || i || n, '') || coalesce('### Functions' || n || n || g || n, '') || coalesce('### Symbols' || n || n || y || n, '') AS content_made FROM lists)
SELECT repository_id, path AS file_path, regexp_extract(path, '[^/]*$') AS title, upper(type) || ' file: ' || path || ' (' || line_count || ' lines)' AS description, 'code://repo/' || path AS resource, length(content_made) AS n_content FROM body""",
    "summaries_read_back": _SUMMARIES + "SELECT repository_id, path, type, n_imports, n_symbols FROM summary WHERE n_imports > 0 OR n_symbols > 0",
    "report_concepts": r"""SELECT 'project' AS type, 'Project Overview' AS title, 'project/project_overview.md' AS file_path, (""" + _FILES + r""", a AS (SELECT 'u' || user_id AS author, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, author LIMIT 10), line AS (
  SELECT '## Project: `demo`' || repeat(chr(10), 2) || '**Branch:** `main`' || repeat(chr(10), 2) || '**Current Commit:** `0123456789ab`' || chr(10) AS l UNION ALL SELECT '**Total Files:** ' || count(*) || chr(10) FROM f UNION ALL SELECT '### File Types' || chr(10)
  UNION ALL SELECT '- **' || type || ':** ' || count(*) || ' files' FROM f GROUP BY type UNION ALL SELECT chr(10) || '### Top Contributors' || chr(10) UNION ALL SELECT '- ' || author || ' (' || n || ' files)' FROM a) SELECT sum(length(l) + 1) FROM line)::INTEGER AS n_content
UNION ALL SELECT 'code_repository', 'Code Repository', 'project/code_repository.md', (""" + _IDS + r""", ents AS (SELECT id FROM sid UNION SELECT id FROM fid UNION SELECT rid FROM fid UNION SELECT pid FROM fid WHERE pkg <> '' UNION SELECT id FROM iid),
rels AS (SELECT rid AS a, id AS b, '' AS c, path AS p, 0 AS l FROM fid UNION SELECT rid, pid, '', '', 0 FROM fid WHERE pkg <> '' UNION SELECT pid, id, '', path, 0 FROM fid WHERE pkg <> '' UNION SELECT fid.id, iid.id, target, path, 0 FROM fid JOIN iid USING (repo, path)
  UNION SELECT fid.id, sid.id, '', path, a FROM fid JOIN sid USING (repo, path) UNION SELECT pid, sid.id, '', path, a FROM fid JOIN sid USING (repo, path) WHERE pkg <> ''),
line AS (SELECT '## Code Repository' || repeat(chr(10), 2) || '**Repository:** `demo`' || repeat(chr(10), 2) || '**Repository ID:** `demo`' || chr(10) AS l
  UNION ALL SELECT '**Indexed Files:** ' || (SELECT count(*) FROM f) || repeat(chr(10), 2) || '**Code Entities:** ' || (SELECT count(*) FROM ents) || repeat(chr(10), 2) || '**Code Relations:** ' || (SELECT count(*) FROM rels) || chr(10)
  UNION ALL SELECT '### Language Distribution' || chr(10) UNION ALL SELECT '- **' || type || ':** ' || count(*) FROM f GROUP BY type UNION ALL SELECT chr(10) || '### Symbol Counts' || chr(10) UNION ALL SELECT '- **' || kind || ':** ' || count(*) FROM s GROUP BY kind
  UNION ALL SELECT chr(10) || '### Generated Artifacts' || repeat(chr(10), 2) || '- `project/code_repository.md`' || chr(10) || '- `project/code_relations.md`' UNION ALL SELECT '- `' || path || '.md`' FROM f) SELECT sum(length(l) + 1) FROM line)::INTEGER""",
    "line_counts": _FILES + " SELECT source_id, CASE WHEN content = '' THEN 0 ELSE len(content) - len(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END AS line_count FROM f",
    "relationship_graph": _GRAPH + "SELECT kind, source, target, meta FROM graph",
    "relationship_lines": _GRAPH + "SELECT CASE kind WHEN 'file_import' THEN 0 WHEN 'package_import' THEN 1 WHEN 'file_owns_symbol' THEN 2 ELSE 3 END AS section, '- `' || source || '` ' || CASE WHEN kind IN ('file_import', 'package_import') THEN 'imports' ELSE 'owns' END || ' `' || target || '`' || CASE WHEN meta <> '' THEN ' (' || meta || ')' ELSE '' END AS line FROM graph",
    "code_entities": _IDS + """SELECT entity_id, kind, lang, provenance FROM (
  SELECT id AS entity_id, 'symbol' AS kind, type AS lang, prov AS provenance FROM sid JOIN f USING (repo, path)
  UNION SELECT id, 'file', type, prov FROM fid UNION SELECT rid, 'repository', '', 'kb-go-ast' FROM fid
  UNION SELECT pid, 'package', arg_min(type, path), arg_min(prov, path) FROM fid WHERE pkg <> '' GROUP BY pid UNION SELECT id, 'import', type, prov FROM iid JOIN f USING (repo, path))""",
    "code_relations": _IDS + """
  SELECT rid AS source_id, id AS target_id, '' AS target_ref, 'contains' AS kind, path AS file_path, 0 AS line_no FROM fid
  UNION SELECT rid, pid, '', 'contains', '', 0 FROM fid WHERE pkg <> '' UNION SELECT pid, id, '', 'contains', path, 0 FROM fid WHERE pkg <> ''
  UNION SELECT fid.id, iid.id, target, 'imports', path, 0 FROM fid JOIN iid USING (repo, path)
  UNION SELECT fid.id, sid.id, '', 'contains', path, a FROM fid JOIN sid USING (repo, path) UNION SELECT pid, sid.id, '', 'contains', path, a FROM fid JOIN sid USING (repo, path) WHERE pkg <> ''""",
    "relation_index_report": _IDS + """, r AS (
  SELECT rid AS source_id, id AS target_id, '' AS target_ref, 'contains' AS kind, path AS file_path, 0 AS line_no, prov FROM fid
  UNION SELECT rid, pid, '', 'contains', '', 0, arg_min(prov, path) FROM fid WHERE pkg <> '' GROUP BY rid, pid UNION SELECT pid, id, '', 'contains', path, 0, prov FROM fid WHERE pkg <> ''
  UNION SELECT fid.id, iid.id, target, 'imports', path, 0, prov FROM fid JOIN iid USING (repo, path)
  UNION SELECT fid.id, sid.id, '', 'contains', path, a, prov FROM fid JOIN sid USING (repo, path) UNION SELECT pid, sid.id, '', 'contains', path, a, prov FROM fid JOIN sid USING (repo, path) WHERE pkg <> '')
SELECT '| ' || kind || ' | `' || source_id || '` | `' || target_id || '` | `' || file_path || CASE WHEN line_no > 0 THEN ':' || line_no ELSE '' END || '` | ' || prov || ' |' AS line FROM r""",
    "language_counts": _SUMMARY + "SELECT type, count(*) AS n FROM f GROUP BY type",
    "symbol_counts": _SUMMARY + "SELECT kind, count(*) AS n FROM s GROUP BY kind",
    "map_graph_nodes": _NODES + "SELECT id AS entity_id, external_id, kind, sk AS symbol_kind, 'external-graph' AS provenance FROM mapped",
    "map_graph_edges": _NODES + """
, byid AS (SELECT external_id, max(id) AS id, arg_max(path, id) AS path FROM mapped GROUP BY 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY loaded_at) AS k FROM code_relations) WHERE k = 1 AND coalesce(target_ref, '') <> ''),
e AS (SELECT r.*, coalesce(CASE WHEN ent.external_id <> '' THEN ent.external_id END, source_entity_id) AS src, r.provenance AS rp FROM r LEFT JOIN ent ON ent.entity_id = source_entity_id)
SELECT coalesce(a.id, src) AS source_id, coalesce(b.id, '') AS target_id, CASE WHEN b.id IS NULL THEN target_ref ELSE '' END AS target_ref, coalesce(e.kind, '') AS kind, coalesce(a.path, '') AS file_path, coalesce(line_no, 0) AS line_no, coalesce(col_no, 0) AS col_no,
  array_to_string(list_concat(list_sort(CASE WHEN coalesce(metadata, '') = '' THEN [] ELSE string_split(metadata, '; ') END), CASE WHEN coalesce(rp, '') <> '' THEN ['codegraph_provenance=' || rp] ELSE [] END), '; ') AS metadata
FROM e LEFT JOIN byid a ON a.external_id = src LEFT JOIN byid b ON b.external_id = target_ref""",
    "map_graph_files": _FILES + " SELECT 'code:' || CASE WHEN repository_id = '' THEN 'repo' ELSE repository_id END || ':' || CASE WHEN path = '' THEN 'file' ELSE path END || '#file:' || CASE WHEN path = '' THEN 'file' ELSE path END AS entity_id, sha256(content) AS external_id, type AS lang FROM f",
    "git_metadata": "SELECT user_id::VARCHAR AS path, arg_max(event_id, (ts, event_id)) AS last_commit, arg_max(event_type, (ts, event_id)) AS last_author, count(*) AS commit_count FROM events GROUP BY user_id",
    "authors_top10": "SELECT row_number() OVER (ORDER BY n DESC, author) AS rank, author, n, round(n * 100.0 / (SELECT count(*) FROM events), 1) AS percent FROM (SELECT 'u' || user_id AS author, count(*) AS n FROM events GROUP BY user_id) ORDER BY n DESC, author LIMIT 10",
    "dir_tree": _FILES + ", d AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory FROM f) SELECT directory, count(*) AS n, CASE WHEN directory = '.' THEN 0 ELSE len(directory) - len(replace(directory, '/', '')) END AS depth FROM d GROUP BY directory",
    "structure_report": _FILES + ", d AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory FROM f) SELECT repeat('  ', CASE WHEN directory = '.' THEN 0 ELSE len(directory) - len(replace(directory, '/', '')) END) || '- `' || directory || '/` (' || count(*) || ' files)' AS line FROM d GROUP BY directory",
    "contributors_report": "SELECT row_number() OVER (ORDER BY n DESC, author) || '. **' || author || '** - ' || n || ' files (' || printf('%.1f', round(n * 100.0 / (SELECT count(*) FROM events), 1)) || '%)' AS line FROM (SELECT 'u' || user_id AS author, count(*) AS n FROM events GROUP BY user_id)",
    "include_files": _FILES + r" SELECT source_id, path FROM f WHERE NOT starts_with(path, 'harbor/') AND NOT starts_with(path, 'alder/') AND (size IS NULL OR size <= 4096) AND regexp_full_match(regexp_extract(path, '[^/]*$'), '[^/]*\.go|[^/]*\.[jt]s|se[^/]l\.py')",
    "glob_match": _FILES + " UNION ALL ".join(f" SELECT source_id, {i} AS pattern_no FROM f WHERE regexp_full_match(path || '/', '{p}')" for i, p in enumerate((r"([^/]*/)*[^/]*\.go/", "harbor/([^/]*/)*", r"[^/]*/[^/]*/[^/]*\.py/", r"([^/]*/)*sea[^/]*/([^/]*/)*[^/]*\.ts/", r"[^/]*\.rs/", "[a-f][^/]*/([^/]*/)*", "([^/]*/)*"))),
    "path_clean": _FILES + " SELECT source_id, path FROM f",
    "detect_changes": _DETECT + "SELECT source_path, result, CASE WHEN result NOT IN ('source_missing', 'no_change') THEN h2 END AS new_hash FROM d",
    "detect_counts": _DETECT + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (result = '{r}') AS {r}" for r in ("new_file", "source_missing", "no_change", "meta_changed", "content_changed")) + " FROM d",
    "index_after_import": _DETECT + "SELECT source_path, 'kb/' || source_path AS target_path, CASE WHEN result IN ('content_changed', 'new_file') THEN h2 ELSE h END AS content_hash, CASE WHEN result = 'content_changed' THEN CASE WHEN strategy = '' THEN 'skip' ELSE strategy END WHEN result = 'new_file' THEN 'skip' ELSE strategy END AS strategy, true AS source_exists FROM d WHERE result <> 'source_missing'",
    "merge_strategies": KB + """, p AS (SELECT ord, type, ord::VARCHAR AS o, repository_id AS r, chr(10) AS n FROM kb), t AS (
  SELECT ord, type, '---' || n || 'owner: ''' || r || '''' || n || 'tags:' || n || '  - a' || o || n || '  - shared' || n || 'title: "S' || o || '"' || n || '---' || n || n || 'source body' AS source,
    '---' || n || 'title: T' || o || n || 'description: D: x' || n || 'tags:' || n || '- shared' || n || '- b' || n || '---' || n || 'body ' || o AS target,
    '---' || n || 'description: D: x' || n || CASE WHEN r <> '' THEN 'owner: ' || r || n ELSE 'owner:' || n END || 'tags:' || n || '  - a' || o || n || '  - b' || n || '  - shared' || n || 'title: T' || o || n || '---' || n || 'body ' || o || n AS merged,
    '---' || n || 'description: D: x' || n || 'tags:' || n || '  - a' || o || n || '  - shared' || n || 'title: S' || o || n || '---' || n || 'body ' || o || n AS patched FROM p)
SELECT ord, CASE type WHEN 'code_file' THEN 'merge' WHEN 'code_symbol' THEN 'patch' WHEN 'api' THEN 'overwrite' ELSE 'skip' END AS used, type IN ('code_file', 'code_symbol', 'api', 'guide') AS changed,
  CASE type WHEN 'guide' THEN source WHEN 'code_file' THEN merged WHEN 'code_symbol' THEN patched WHEN 'api' THEN source ELSE target END AS result FROM t""",
    "upsert_incremental": KB + """, k AS (SELECT ord, type, title, CASE WHEN resource <> '' THEN 'r:' || resource WHEN file_path <> '' THEN 'f:' || file_path END AS key, resource FROM kb),
ev AS (
  SELECT 0 AS round, ord, title, key, false AS dead FROM k WHERE type NOT IN ('code_repository', 'code_relation_index', 'code_context_view')
  UNION ALL SELECT 1, ord, 'new ' || title, key, false FROM k WHERE type = 'code_file'
  UNION ALL SELECT 1, ord, title, 'r:' || resource, true FROM k WHERE type = 'metric' AND resource <> ''
  UNION ALL SELECT 1, ord, title, 'r:code://repo/' || resource, true FROM k WHERE type = 'metric' AND resource <> '')
SELECT ord, title FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round DESC, ord DESC) AS last FROM ev WHERE key IS NOT NULL) WHERE last = 1 AND NOT dead
UNION ALL SELECT ord, title FROM ev WHERE key IS NULL AND NOT dead""",
}
