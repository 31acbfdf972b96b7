"""Queries on documents with frontmatter: parsing, rendering, the one-level form, names and counters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions.text import base_name, dir_name, extension, glob_matches, nz
from marrow.operators import bundle, changes, codegraph, rank
from marrow.plans.tables import KB, concepts, once, table
from marrow.sources import markdown


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every concept as a document, some without type, some without frontmatter."""
    c = once(concepts(spark, sf_dir).select("ord", "type", "repository_id", "file_path"))
    o = F.col("ord").cast("string")
    front = F.concat(F.lit("---\n"), F.when(nz("type") != "", F.concat(F.lit("type: '"), "type", F.lit("'\n"))).otherwise(""), F.lit("title: \"No. "), o, F.lit("\"\ntags: [a, 'b c', "), o, F.lit("]\nowner: "), F.when(nz("repository_id") == "", "null").otherwise(F.col("repository_id")), F.lit("\nlevel: "), o, F.lit("\n---\n\nBody "), o, F.lit("\n"))
    text = F.when(F.col("type") == "guide", F.concat(F.lit("Plain "), o)).otherwise(front)
    return c.select("ord", F.concat(F.lit("kb/doc-"), o, F.lit("_x.md")).alias("file_path"), text.alias("text"))


def documents_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = markdown.parse_texts(_texts(spark, sf_dir))
    return p.select("ord", nz("type").alias("type"), nz("title").alias("title"), nz(F.array_join("tags", "|")).alias("tags"), nz("content").alias("content"), nz(F.try_element_at("custom", F.lit("owner"))).alias("owner"), nz(F.try_element_at("custom_types", F.lit("level"))).alias("level_kind"), F.coalesce(F.col("error"), F.lit("")).alias("error"))


def documents_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = markdown.parse_texts(_texts(spark, sf_dir))
    return p.groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


def frontmatter_one_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-level reading: an inline list stays one value."""
    t = _texts(spark, sf_dir).withColumn("f", changes.split_frontmatter(F.col("text")))
    return t.select("ord", F.col("f.found").alias("found"), nz(F.try_element_at("f.scalars", F.lit("title"))).alias("title"), nz(F.try_element_at("f.scalars", F.lit("tags"))).alias("tags"), F.col("f.body").alias("body"))


def frontmatter_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir).where("text like '---%'").withColumn("f", changes.split_frontmatter(F.col("text")))
    return t.select("ord", changes.render_frontmatter(F.col("f.scalars"), F.col("f.lists"), F.col("f.body")).alias("text"))


def save_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files made of type and title; shared titles are numbered."""
    c = once(concepts(spark, sf_dir).select("ord", "type", "title")).withColumn("file_path", F.lit(""))
    return markdown.save_paths(c).select("ord", "save_path")


def safe_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = concepts(spark, sf_dir).select(F.explode("tags").alias("tag")).distinct()
    return t.select("tag", codegraph.safe_tag(F.col("tag")).alias("safe"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = once(concepts(spark, sf_dir).select("ord", "file_path"))
    p = F.col("file_path")
    return c.select("ord", base_name(p).alias("base"), dir_name(p).alias("dir"), extension(p).alias("ext"))


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all paths in the code graph, those without a file now are deleted."""
    asked = table(spark, sf_dir, "code_entities").where("file_path <> ''").select(F.col("file_path").alias("path")).distinct()
    here = table(spark, sf_dir, "source_files").select(F.col("file_path").alias("path"))
    return changes.tombstones(asked, here)


def trusted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that say they were generated from the file their resource names."""
    c = concepts(spark, sf_dir).withColumn("resource", F.concat(F.lit("code://repo/"), nz(F.try_element_at("custom", F.lit("source_path")))))
    generator = c.select(F.max(nz(F.try_element_at("custom", F.lit("generator"))))).first()[0]
    return once(c.where(changes.trusted_to_delete(generator or "")).select("ord"))


def field_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom fields as numbers and truth values."""
    c = once(concepts(spark, sf_dir).select("ord", "custom"))
    return c.select("ord", rank.whole_number("start_line").alias("start_line"), rank.truth("generated").alias("generated"), rank.whole_number("status").alias("no_number"))


def concepts_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter pushed into loading: documents of a folder by glob."""
    c = once(concepts(spark, sf_dir).select("ord", "file_path"))
    return c.where(glob_matches(F.col("file_path"), "code_*/**/*.go")).select("ord")


def overlay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = once(concepts(spark, sf_dir).select("ord", "type", "resource", "file_path", "custom"))
    got = bundle.collapse_overlays(bundle.overlay(c, c))
    return got.agg(F.count("*").alias("kept"), F.sum(F.coalesce(F.size("duplicate_sources"), F.lit(0))).alias("duplicates"))


QUERIES = {f.__name__: f for f in (
    documents_parse, documents_rejects, frontmatter_one_level, frontmatter_rendered, save_paths, safe_tags, path_parts, tombstones, trusted_files, field_coercions, concepts_below, overlay_counts,
)}

_T = KB + """, t AS (SELECT ord, ord::VARCHAR AS o, chr(10) AS n, type, repository_id AS r, type = 'guide' AS plain FROM kb)
"""
_C = "coalesce(custom['{0}'], '')"
SQL = {
    "documents_parse": _T + """SELECT ord, CASE WHEN plain THEN 'concept' ELSE type END AS type, CASE WHEN plain THEN 'doc ' || o || ' x' WHEN type = '' THEN '' ELSE 'No. ' || o END AS title, CASE WHEN plain OR type = '' THEN '' ELSE 'a|b c|' || o END AS tags,
  CASE WHEN plain THEN 'Plain ' || o WHEN type = '' THEN '' ELSE 'Body ' || o || n END AS content, CASE WHEN plain OR type = '' THEN '' ELSE r END AS owner, CASE WHEN plain OR type = '' THEN '' ELSE 'number' END AS level_kind, CASE WHEN type = '' THEN 'missing type' ELSE '' END AS error FROM t""",
    "documents_rejects": _T + "SELECT CASE WHEN type = '' THEN 'missing type' ELSE '' END AS error, count(*) AS n FROM t GROUP BY 1",
    "frontmatter_one_level": _T + "SELECT ord, NOT plain AS found, CASE WHEN plain THEN '' ELSE 'No. ' || o END AS title, CASE WHEN plain THEN '' ELSE '[a, ''b c'', ' || o || ']' END AS tags, CASE WHEN plain THEN 'Plain ' || o ELSE 'Body ' || o || n END AS body FROM t",
    "frontmatter_rendered": _T + "SELECT ord, '---' || n || 'level: ' || o || n || 'owner: ' || CASE WHEN r = '' THEN 'null' ELSE r END || n || 'tags: [a, ''b c'', ' || o || ']' || n || 'title: No. ' || o || n || CASE WHEN type <> '' THEN CASE WHEN trim(type) = '' THEN 'type:' ELSE 'type: ' || type END || n ELSE '' END || '---' || n || 'Body ' || o || n AS text FROM t WHERE NOT plain",
    "save_paths": KB + r""", p AS (SELECT ord, CASE WHEN type = '' THEN 'concepts' ELSE type || 's' END || '/' || translate(title, '/\:*?"<>|', '_________') AS stem FROM kb), k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY ord) - 1 AS k FROM p)
SELECT ord, stem || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.md' AS save_path FROM k""",
    "safe_tags": KB + ", g AS (SELECT DISTINCT unnest(tags) AS tag FROM kb) SELECT tag, regexp_replace(replace(lower(tag), ' ', '-'), '[^a-z0-9_\\-]', '_', 'g') AS safe FROM g",
    "path_parts": KB + "SELECT ord, regexp_extract(file_path, '[^/]*$') AS base, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS dir, regexp_extract(file_path, '(\\.[^./]*)$', 1) AS ext FROM kb",
    "tombstones": "SELECT DISTINCT file_path AS path, file_path NOT IN (SELECT file_path FROM source_files WHERE file_path IS NOT NULL) AS deleted FROM code_entities WHERE file_path <> ''",
    "trusted_files": KB + f"SELECT ord FROM kb WHERE lower({_C.format('generated')}) = 'true' AND {_C.format('generator')} <> '' AND {_C.format('source_path')} <> '' AND {_C.format('generator')} = (SELECT max({_C.format('generator')}) FROM kb)",
    "field_coercions": KB + f"SELECT ord, coalesce(try_cast(regexp_extract({_C.format('start_line')}, '^[0-9]+') AS INTEGER), 0) AS start_line, lower({_C.format('generated')}) = 'true' AS generated, 0 AS no_number FROM kb",
    "concepts_below": KB + r"SELECT ord FROM kb WHERE regexp_full_match(file_path, 'code_[^/]*/([^/]*/)*[^/]*\.go')",
    "overlay_counts": KB + f""", two AS (SELECT 0 AS r, * FROM kb UNION ALL SELECT 1, * FROM kb), keyed AS (SELECT CASE WHEN lower({_C.format("generated")}) = 'true' AND {_C.format("generator")} <> '' AND {_C.format("source_path")} <> '' AND type <> '' AND (resource <> '' OR file_path <> '')
  THEN {_C.format("generator")} || chr(1) || {_C.format("source_path")} || chr(1) || type || chr(1) || CASE WHEN resource <> '' THEN resource ELSE file_path END ELSE 'own' || r || '-' || ord END AS k FROM two)
SELECT count(DISTINCT k) AS kept, count(*) - count(DISTINCT k) AS duplicates FROM keyed""",
}
