"""Queries on filters, search, bundles, lint and ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions.text import norm_key
from marrow.operators import bundle, lint, predicates, rank
from marrow.operators.predicates import Query
from marrow.plans.tables import ENTITIES, KB, concepts, once, relation_concepts, symbol_concepts


def _found(df: DataFrame) -> DataFrame:
    return once(df.select("ord", "title"))


def filter_type_tags_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(Query(type="code_file", tags=("code", "generated"), text="MARKER").execute(concepts(spark, sf_dir)))


def filter_resource_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query().with_(resource="CODE://", title_regex=r"^\w+ \w+ \w+$", description_regex=r"\.$", content_regex=r"(?m)^#+ \w+")
    return _found(q.execute(concepts(spark, sf_dir)))


def invalid_regex_matches_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = concepts(spark, sf_dir)
    return _found(Query(title_regex="(").execute(c).unionByName(Query(title_regex="a(?=b)").execute(c)))


def search_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(predicates.search(concepts(spark, sf_dir), "ÜBER"))


def search_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(predicates.search_ascii(concepts(spark, sf_dir), "ÜBER"))


def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search that also finds symbols by name, with the symbols found."""
    got = predicates.search_with_matches(symbol_concepts(spark, sf_dir), "Registry")
    return got.select("file_path", F.array_join(F.transform("symbol_matches", lambda s: s["name"]), ",").alias("matches"))


def filter_by_tag_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = once(concepts(spark, sf_dir).select("ord", "tags"))
    return predicates.indexed_by_tag(c, "code").select("ord")


def filter_by_tag_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(predicates.by_tag(concepts(spark, sf_dir), "code"))


def filter_by_type_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empty type finds rows without type by comparison, and nothing by index."""
    c = concepts(spark, sf_dir)
    rows = predicates.by_type(c, "").select("ord", F.lit("compared").alias("how")).unionByName(predicates.indexed_by_type(c, "").select("ord", F.lit("indexed").alias("how")))
    return rows.distinct()


def filter_by_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(predicates.by_resource(concepts(spark, sf_dir), ""))


def get_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.get_concept(concepts(spark, sf_dir), "Index").select("ord", "title", "file_path")


def remove_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(bundle.remove_concept(concepts(spark, sf_dir), "Index"))


def add_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = once(concepts(spark, sf_dir).select("ord", "type", "title", "file_path"))
    new = spark.createDataFrame([("table", "A/B: new?", ""), ("", "Plain", ""), ("api", "Kept", "x/y.md")], "type string, title string, file_path string")
    return bundle.add_concepts(c, new.coalesce(1)).select("ord", "title", "file_path")


def related_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = concepts(spark, sf_dir)
    return bundle.related_to(c, bundle.get_concept(c, "Overview")).select("ord")


def bundle_stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.stats(once(concepts(spark, sf_dir).select("ord", "type", "tags")))


def bundle_stats_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.type_counts(once(concepts(spark, sf_dir).select("ord", "type")))


def bundle_stats_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.tag_counts(once(concepts(spark, sf_dir).select("ord", "tags")))


def overlay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle under an overlay that holds its generated files again: the first of each generated concept stays."""
    c = once(concepts(spark, sf_dir).select("ord", "type", "resource", "file_path", "custom"))
    over = c.where(F.col("type") == "code_file").withColumn("file_path", F.concat(F.lit("overlay/"), "file_path"))
    got = bundle.collapse_overlays(bundle.overlay(c, over))
    return got.select("ord", "source_rank", "file_path", F.coalesce(F.size("duplicate_sources"), F.lit(0)).cast("long").alias("n_duplicates"))


def symbols_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbol_concepts(spark, sf_dir)
    return s.select("file_path", F.explode(predicates.symbols(F.col("content"))).alias("s")).select("file_path", "s.*")


def relation_rows_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relation_concepts(spark, sf_dir)
    return r.select("ord", F.explode(predicates.relation_rows(F.col("content"))).alias("r")).select("ord", "r.kind", "r.source", "r.target", "r.location")


def code_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(code_language=" GO ", code_symbol_kind="Method", code_qualified_name="registry", code_file_path="/")
    return q.execute(symbol_concepts(spark, sf_dir)).select("file_path", "title")


def code_relation_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(code_relation_kind="CALLS", code_relation_source="/", code_relation_target=".GO")
    return q.execute(relation_concepts(spark, sf_dir)).select("ord", "title")


def exact_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = predicates.exact_filter(type="code_file", language="PYTHON", tag="code")
    return _found(Query(code_language="python").execute(concepts(spark, sf_dir)).where(where))


def dispatch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(predicates.dispatch_search(concepts(spark, sf_dir), text="registry", type_="code_file", code_language="rust"))


_RANKED = ("ord", "title", "source_path", "location", "start_line", "score", "reason", "provenance", "generated", "rank")


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one scan, eleven signals, the best twenty."""
    # deliveries of one concept are made one while rows are narrow, before the limit
    scored = rank.hits(rank.scored(concepts(spark, sf_dir), "the registry"))
    best = once(scored).orderBy(*rank.order()).limit(20)
    return rank.with_rank(best).select(*_RANKED)


def ranked_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.ranked(symbol_concepts(spark, sf_dir), "Registry", 20).select("concept_path", "title", "location", "qualified_name", "score", "exactness", "reason", "rank")


def ranked_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit with its rank, numbered without a single partition."""
    rows = once(rank.hits(rank.scored(concepts(spark, sf_dir), "lint")))
    return rank.numbered(rows.orderBy(*rank.order()), "rank").select("ord", "score", "rank")


BATCH = tuple(enumerate(("registry", "go", "code_file", "frontmatter", "the harbor", "tombstone", "index", "README", "缓存", "über")))


def ranked_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten queries in one scan, the best five of each."""
    rows = rank.many(concepts(spark, sf_dir), BATCH).dropDuplicates(["query_id", "ord"])
    return rank.best_of_each(rows, 5).select("query_id", "ord", "score", "rank")


def lint_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = lint.Config(required_tags=("code",))
    return lint.lint(concepts(spark, sf_dir), cfg).select("ord", "code", "severity", "line")


def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.summary(lint.lint(concepts(spark, sf_dir)))


def title_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.title_counts(once(concepts(spark, sf_dir).select("ord", "title")))


def criteria_intersected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two indexes agree upon."""
    c = once(concepts(spark, sf_dir).select("ord", "type", "tags"))
    return predicates.indexed_by_type(c, "code_file").join(predicates.indexed_by_tag(c, "code").select("ord"), "ord", "left_semi").select("ord")


def keys_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources in the form in which fields are compared."""
    c = once(concepts(spark, sf_dir).select("ord", "resource", "title"))
    return c.select("ord", norm_key(F.concat(F.lit("  "), F.col("resource"), F.lit("\t"))).alias("resource"), norm_key(F.col("title")).alias("title"))


QUERIES = {f.__name__: f for f in (
    criteria_intersected, keys_normalised,
    filter_type_tags_text, filter_resource_regex, invalid_regex_matches_nothing, search_unicode, search_ascii, search_symbols, filter_by_tag_dups, filter_by_tag_once,
    filter_by_type_empty, filter_by_resource, get_first, remove_first, add_concept, related_concepts, bundle_stats_summary, bundle_stats_types, bundle_stats_tags, overlay_dedup,
    symbols_extract, relation_rows_extract, code_filters, code_relation_filters, exact_postfilter, dispatch_search, ranked_search, ranked_symbols, ranked_all, ranked_batch,
    lint_all, lint_summary, title_counts,
)}

_TEXT = "(contains(lower(title), lower({0})) OR contains(lower(description), lower({0})) OR contains(lower(content), lower({0})))"
_ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_C = "coalesce(custom['{0}'], '')"


def _score(q: str) -> str:
    """Points of a concept for a query, as SQL over kb."""
    return f"""
  (CASE WHEN lower(title) = {q} OR lower(trim({_C.format("qualified_name")})) = {q} THEN 120
        WHEN lower(trim({_C.format("qualified_name")})) <> '' AND contains(lower({_C.format("qualified_name")}), {q}) THEN 70 ELSE 0 END)
  + (CASE WHEN lower(title) = {q} THEN 80 WHEN contains(lower(title), {q}) THEN 40 ELSE 0 END)
  + (CASE WHEN contains(lower(resource), {q}) THEN 50 ELSE 0 END)
  + (CASE WHEN contains(lower({_C.format("symbol_kind")}), {q}) THEN 25 ELSE 0 END)
  + (CASE WHEN contains(lower(description), {q}) THEN 30 ELSE 0 END)
  + (CASE WHEN contains(lower(content), {q}) THEN 10 ELSE 0 END)"""


def _exactness(q: str) -> str:
    return f"(CASE WHEN lower(title) = {q} OR lower(trim({_C.format('qualified_name')})) = {q} THEN 100 WHEN contains(lower({_C.format('qualified_name')}), {q}) THEN 70 WHEN contains(lower(title), {q}) THEN 50 ELSE 0 END)"


def _reason(q: str) -> str:
    return f"""array_to_string(list_filter([
    CASE WHEN lower(title) = {q} OR lower(trim({_C.format("qualified_name")})) = {q} THEN 'exact symbol match' WHEN contains(lower({_C.format("qualified_name")}), {q}) THEN 'qualified symbol match' END,
    CASE WHEN lower(title) = {q} THEN 'exact title match' WHEN contains(lower(title), {q}) THEN 'title match' END,
    CASE WHEN contains(lower(resource), {q}) THEN 'resource match' END, CASE WHEN contains(lower({_C.format("symbol_kind")}), {q}) THEN 'symbol kind match' END,
    CASE WHEN contains(lower(description), {q}) THEN 'description match' END, CASE WHEN contains(lower(content), {q}) THEN 'content match' END], lambda x: x IS NOT NULL), ', ')"""


# Source paths of the test tables need cleaning in one way only: the double slash of a scheme.
_PATH = f"(CASE WHEN trim({_C.format('source_path')}) <> '' THEN {_C.format('source_path')} WHEN starts_with(resource, 'code://repo/') THEN substr(resource, 13) ELSE replace(resource, '//', '/') END)"
_LINE = f"coalesce(try_cast(regexp_extract({_C.format('start_line')}, '^[+-]?[0-9]+') AS INTEGER), 0)"
_END = f"coalesce(try_cast(regexp_extract({_C.format('end_line')}, '^[+-]?[0-9]+') AS INTEGER), 0)"
_TYPE_RANK = "(CASE type WHEN 'code_symbol' THEN 40 WHEN 'code_relation' THEN 30 WHEN 'code_relation_index' THEN 30 WHEN 'code_file' THEN 20 ELSE 10 END)"


def _hits(q: str) -> str:
    return f"""SELECT ord, title, type, {_PATH} AS source_path, file_path AS concept_path, {_LINE} AS start_line, {_END} AS end_line, {_C.format("qualified_name")} AS qualified_name,
  {_score(q)} AS score, {_exactness(q)} AS exactness, {_reason(q)} AS reason, {_TYPE_RANK} AS type_rank,
  CASE WHEN trim({_C.format("provenance")}) <> '' THEN {_C.format("provenance")} WHEN starts_with(type, 'code_') THEN 'kb.code' ELSE 'kb.markdown' END AS provenance,
  lower({_C.format("generated")}) = 'true' AS generated FROM kb"""


_ORDER = "score DESC, exactness DESC, type_rank DESC, source_path, start_line, title, concept_path, ord"
_LOCATION = "CASE WHEN source_path = '' THEN '' WHEN start_line <= 0 THEN source_path WHEN end_line <= 0 OR end_line = start_line THEN source_path || ':' || start_line ELSE source_path || ':' || start_line || '-' || end_line END AS location"
_SYMBOLS = ENTITIES + """, kb AS (
  SELECT 0 AS ord, 'code_symbol' AS type, coalesce(entity_name, '') AS title, coalesce(docstring, '') AS description, 'code://repo/' || coalesce(file_path, '') AS resource, entity_id AS file_path,
    '- Language: `' || coalesce(lang, '') || '`' || chr(10) || '- Path: `' || coalesce(file_path, '') || '`' || chr(10) || chr(10) || '- `' || coalesce(symbol_kind, '') || '` `' || coalesce(qualified_name, '') || '` ('
      || CASE WHEN coalesce(visibility, '') = '' THEN 'unknown' ELSE visibility END || ') at `' || coalesce(file_path, '') || ':' || coalesce(start_line::VARCHAR, '') || '-' || coalesce(end_line::VARCHAR, '') || '`' || chr(10) AS content,
    MAP {'source_path': coalesce(file_path, ''), 'language': coalesce(lang, ''), 'symbol_kind': coalesce(symbol_kind, ''), 'qualified_name': coalesce(qualified_name, ''),
      'start_line': coalesce(start_line::VARCHAR, ''), 'end_line': coalesce(end_line::VARCHAR, ''), 'provenance': coalesce(provenance, ''), 'generated': 'true'} AS custom FROM sym
)
"""
_LINT = KB + r"""
, line AS (SELECT ord, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i, unnest(string_split(content, chr(10))) AS l FROM kb),
tag AS (SELECT ord, unnest(range(1, len(tags) + 1)) AS i, unnest(tags) AS t FROM kb WHERE len(tags) > 0),
issue AS (
  SELECT ord, 'KB001' AS code, 'ERROR' AS severity, 1 AS line FROM kb WHERE trim(type) = ''
  UNION ALL SELECT ord, 'KB002', 'ERROR', 1 FROM kb WHERE trim(title) = ''
  UNION ALL SELECT ord, 'KB003', 'WARN', 3 FROM kb WHERE strlen(trim(description, chr(9) || chr(10) || chr(13) || ' ')) < 10
  UNION ALL SELECT ord, 'KB004', 'WARN', 1 FROM kb WHERE type <> '' AND NOT regexp_full_match(type, '[a-z][a-z0-9_]*')
  UNION ALL SELECT ord, 'KB005', 'WARN', 6 FROM kb WHERE NOT (regexp_full_match(stamp, '[0-9]{4}-[0-9]{2}-[0-9]{2}(T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.,][0-9]+)?(Z|[+-]([01][0-9]|2[0-4]):([0-5][0-9]|60)))?') AND try_cast(substr(stamp, 1, 10) AS DATE) IS NOT NULL)
  UNION ALL SELECT ord, 'KB006', 'WARN', 5 FROM tag WHERE lower(t) <> t
  UNION ALL SELECT ord, 'KB006', 'WARN', 5 FROM tag WHERE contains(t, ' ')
  UNION ALL SELECT ord, 'KB007', 'WARN', 8 FROM kb WHERE trim(content, chr(9) || chr(10) || chr(13) || ' ') = ''
  UNION ALL SELECT ord, 'KB009', 'WARN', 7 + i FROM (SELECT ord, i, row_number() OVER (PARTITION BY ord ORDER BY i) AS k FROM line WHERE strlen(l) > 240) WHERE k <= 6
  UNION ALL SELECT ord, 'KB010', 'WARN', 5 FROM kb WHERE len(list_distinct(tags)) < len(tags)
  UNION ALL SELECT ord, 'KB013', 'WARN', 0 FROM (SELECT ord, count(*) OVER (PARTITION BY title) AS n FROM kb) WHERE n > 1
)
"""
_KEYS = """, one AS (SELECT * FROM kb WHERE title = 'Overview' ORDER BY ord LIMIT 1)"""

SQL = {
    "criteria_intersected": KB + "SELECT ord FROM kb WHERE type = 'code_file' AND list_contains(tags, 'code')",
    "keys_normalised": KB + "SELECT ord, lower(trim(resource, chr(9) || chr(10) || chr(13) || ' ')) AS resource, lower(trim(title, chr(9) || chr(10) || chr(13) || ' ')) AS title FROM kb",
    "filter_type_tags_text": KB + f"SELECT ord, title FROM kb WHERE type = 'code_file' AND list_contains(tags, 'code') AND list_contains(tags, 'generated') AND {_TEXT.format(chr(39) + 'MARKER' + chr(39))}",
    "filter_resource_regex": KB + r"SELECT ord, title FROM kb WHERE contains(lower(resource), 'code://') AND regexp_matches(title, '^\w+ \w+ \w+$') AND regexp_matches(description, '\.$') AND regexp_matches(content, '(?m)^#+ \w+')",
    "invalid_regex_matches_nothing": KB + "SELECT ord, title FROM kb WHERE false",
    "search_unicode": KB + f"SELECT ord, title FROM kb WHERE {_TEXT.format(chr(39) + 'ÜBER' + chr(39))}",
    "search_ascii": KB + "SELECT ord, title FROM kb WHERE " + " OR ".join(f"contains({_ASCII.format(c)}, 'Über')" for c in ("title", "description", "content")),
    "search_symbols": _SYMBOLS + f"SELECT file_path, CASE WHEN contains(lower({_C.format('qualified_name')}), 'registry') THEN {_C.format('qualified_name')} ELSE '' END AS matches FROM kb WHERE contains(lower(title), 'registry') OR contains(lower(description), 'registry') OR contains(lower(content), 'registry')",
    "filter_by_tag_dups": KB + "SELECT ord FROM (SELECT ord, unnest(tags) AS t FROM kb) WHERE t = 'code'",
    "filter_by_tag_once": KB + "SELECT ord, title FROM kb WHERE list_contains(tags, 'code')",
    "filter_by_type_empty": KB + "SELECT ord, 'compared' AS how FROM kb WHERE type = ''",
    "filter_by_resource": KB + "SELECT ord, title FROM kb WHERE resource = ''",
    "get_first": KB + "SELECT ord, title, file_path FROM kb WHERE title = 'Index' ORDER BY ord LIMIT 1",
    "remove_first": KB + "SELECT ord, title FROM kb WHERE ord <> (SELECT min(ord) FROM kb WHERE title = 'Index')",
    "add_concept": KB + "SELECT ord, title, file_path FROM kb UNION ALL SELECT m + 1, 'A/B: new?', 'tables/A_B_ new_.md' FROM (SELECT max(ord) AS m FROM kb) UNION ALL SELECT m + 2, 'Plain', 'concepts/Plain.md' FROM (SELECT max(ord) AS m FROM kb) UNION ALL SELECT m + 3, 'Kept', 'x/y.md' FROM (SELECT max(ord) AS m FROM kb)",
    "related_concepts": KB + _KEYS + "SELECT kb.ord FROM kb, one WHERE kb.ord <> one.ord AND (list_has_any(kb.tags, one.tags) OR (kb.resource <> '' AND kb.resource = one.resource))",
    "bundle_stats_summary": KB + "SELECT (SELECT count(*) FROM kb) AS n_concepts, (SELECT count(DISTINCT type) FROM kb WHERE type <> '') AS n_types, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM kb)) AS n_tags",
    "bundle_stats_types": KB + "SELECT type, count(*) AS n FROM kb WHERE type <> '' GROUP BY type",
    "bundle_stats_tags": KB + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM kb) GROUP BY tag",
    "overlay_dedup": KB + f"""
, two AS (SELECT 0 AS source_rank, * FROM kb UNION ALL SELECT 1, * REPLACE ('overlay/' || file_path AS file_path) FROM kb WHERE type = 'code_file'),
keyed AS (SELECT *, CASE WHEN lower({_C.format("generated")}) = 'true' AND {_C.format("generator")} <> '' AND {_C.format("source_path")} <> '' AND type <> '' AND (resource <> '' OR file_path <> '')
  THEN {_C.format("generator")} || chr(1) || {_C.format("source_path")} || chr(1) || type || chr(1) || CASE WHEN resource <> '' THEN resource ELSE file_path END ELSE 'own' || source_rank || '-' || ord END AS k FROM two)
SELECT ord, source_rank, file_path, n - 1 AS n_duplicates FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_rank, ord) AS r, count(*) OVER (PARTITION BY k) AS n FROM keyed) WHERE r = 1""",
    "symbols_extract": ENTITIES + "SELECT entity_id AS file_path, symbol_kind AS kind, qualified_name AS name, CASE WHEN coalesce(visibility, '') = '' THEN 'unknown' ELSE visibility END AS visibility, file_path || ':' || coalesce(start_line::VARCHAR, '') || '-' || coalesce(end_line::VARCHAR, '') AS location FROM sym WHERE coalesce(symbol_kind, '') <> '' AND coalesce(qualified_name, '') <> ''",
    "relation_rows_extract": ENTITIES + r"SELECT relation_id AS ord, kind, trim(source, chr(9) || chr(10) || chr(13) || ' ') AS source, trim(target, chr(9) || chr(10) || chr(13) || ' ') AS target, coalesce(file_path, '') || ':' || coalesce(line_no, 0) AS location FROM rel WHERE source <> '' AND target <> '' AND coalesce(kind, '') <> '' AND coalesce(provenance, '') <> ''",
    "code_filters": ENTITIES + "SELECT entity_id AS file_path, entity_name AS title FROM sym WHERE lower(trim(lang)) = 'go' AND lower(symbol_kind) = 'method' AND contains(lower(qualified_name), 'registry') AND contains(file_path, '/')",
    "code_relation_filters": ENTITIES + "SELECT relation_id AS ord, kind || ' ' || relation_id AS title FROM rel WHERE lower(kind) = 'calls' AND contains(lower(source), '/') AND contains(lower(target), '.go')",
    "exact_postfilter": KB + f"SELECT ord, title FROM kb WHERE type = 'code_file' AND lower({_C.format('language')}) = 'python' AND list_contains(tags, 'code')",
    "dispatch_search": KB + f"SELECT ord, title FROM kb WHERE type = 'code_file' AND lower(trim({_C.format('language')})) = 'rust' AND {_TEXT.format(chr(39) + 'registry' + chr(39))}",
    "ranked_search": KB + f"SELECT ord, title, source_path, location, start_line, score, reason, provenance, generated, rank FROM (SELECT *, {_LOCATION}, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM ({_hits(chr(39) + 'the registry' + chr(39))}) WHERE score > 0) WHERE rank <= 20",
    "ranked_symbols": _SYMBOLS + f"SELECT concept_path, title, location, qualified_name, score, exactness, reason, rank FROM (SELECT *, {_LOCATION}, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM ({_hits(chr(39) + 'registry' + chr(39))}) WHERE score > 0) WHERE rank <= 20",
    "ranked_all": KB + f"SELECT ord, score, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM ({_hits(chr(39) + 'lint' + chr(39))}) WHERE score > 0",
    "ranked_batch": KB + " UNION ALL ".join(f"SELECT {i}::INTEGER AS query_id, ord, score, rank FROM (SELECT ord, score, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM ({_hits(repr(q.lower()))}) WHERE score > 0) WHERE rank <= 5" for i, q in BATCH),
    "lint_all": _LINT + "SELECT * FROM issue UNION ALL SELECT ord, 'KB011', 'WARN', 5 FROM kb WHERE NOT list_contains(tags, 'code')",
    "lint_summary": _LINT + "SELECT count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARN') AS warnings, count(*) FILTER (severity = 'INFO') AS infos FROM issue",
    "title_counts": KB + "SELECT title, count(*) AS n FROM kb GROUP BY title",
}
