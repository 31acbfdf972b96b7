"""The test tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions.text import nz


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts as they are delivered; those delivered again are alike, so queries drop them once they are narrow (``once``).

    The type stays as it is stored, so that a filter on it reaches the scan.
    """
    c = table(spark, sf_dir, "concepts")
    return c.select(
        "ord", F.col("concept_type").alias("type"), *(nz(x).alias(x) for x in ("title", "description", "resource")),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit(""))).alias("tags"),
        nz("concept_ts").alias("timestamp"), nz("content").alias("content"), nz("file_path").alias("file_path"), "custom", nz("repository_id").alias("repository_id"),
    )


def once(df: DataFrame) -> DataFrame:
    """One row per concept."""
    return df.dropDuplicates(["ord"])


KB = """
WITH kb AS (
  SELECT ord, coalesce(concept_type, '') AS type, coalesce(title, '') AS title, coalesce(description, '') AS description, coalesce(resource, '') AS resource,
    list_transform(coalesce(tags, []), lambda t: coalesce(t, '')) AS tags, coalesce(concept_ts, '') AS stamp, coalesce(content, '') AS content,
    coalesce(file_path, '') AS file_path, custom, coalesce(repository_id, '') AS repository_id
  FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY loaded_at DESC) AS rn FROM concepts) WHERE rn = 1
)
"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest life of each entity."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "code_entities")
    w = Window.partitionBy("entity_id").orderBy(F.col("indexed_at").desc_nulls_last(), F.xxhash64(*e.columns))
    return e.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def symbol_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol as a concept whose body has the lines that generated bodies have."""
    e = entities(spark, sf_dir).where("kind = 'symbol'")
    line = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    place = F.concat(nz("file_path"), F.lit(":"), line("start_line"), F.lit("-"), line("end_line"))
    body = F.concat(F.lit("- Language: `"), nz("lang"), F.lit("`\n- Path: `"), nz("file_path"), F.lit("`\n\n- `"), nz("symbol_kind"), F.lit("` `"), nz("qualified_name"), F.lit("` ("), F.when(nz("visibility") == "", "unknown").otherwise(nz("visibility")), F.lit(") at `"), place, F.lit("`\n"))
    custom = F.create_map(*(x for k, v in (("source_path", nz("file_path")), ("language", nz("lang")), ("symbol_kind", nz("symbol_kind")), ("qualified_name", nz("qualified_name")), ("start_line", line("start_line")), ("end_line", line("end_line")), ("provenance", nz("provenance")), ("generated", F.lit("true"))) for x in (F.lit(k), v)))
    return e.select(
        F.lit(0).cast("long").alias("ord"), F.lit("code_symbol").alias("type"), nz("entity_name").alias("title"), nz("docstring").alias("description"),
        F.concat(F.lit("code://repo/"), nz("file_path")).alias("resource"), F.array(F.lit("code"), nz("lang")).alias("tags"), F.lit("").alias("timestamp"),
        body.alias("content"), F.col("entity_id").alias("file_path"), custom.alias("custom"), nz("repository_id").alias("repository_id"),
    )


def relation_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each relation between entities as a concept with relation fields, source and target being paths of files."""
    r = table(spark, sf_dir, "code_relations").dropDuplicates(["relation_id"])
    target = F.when(nz("target_id") != "", F.regexp_extract(F.trim("target_id"), r"^code:[^:]*:([^#]*)#", 1)).otherwise(nz("target_ref"))
    source = F.regexp_extract("source_entity_id", r"^code:[^:]*:([^#]*)#", 1)
    custom = F.create_map(F.lit("relation_kind"), nz("kind"), F.lit("relation_source"), source, F.lit("relation_target"), target)
    row = F.concat(F.lit("| "), nz("kind"), F.lit(" | `"), source, F.lit("` | `"), target, F.lit("` | `"), nz("file_path"), F.lit(":"), F.coalesce(F.col("line_no").cast("string"), F.lit("0")), F.lit("` | "), nz("provenance"), F.lit(" |"))
    return r.select(
        F.col("relation_id").alias("ord"), F.lit("code_relation").alias("type"), F.concat(nz("kind"), F.lit(" "), F.col("relation_id").cast("string")).alias("title"), F.lit("").alias("description"), F.lit("").alias("resource"),
        F.array(F.lit("code")).alias("tags"), F.lit("").alias("timestamp"), F.concat(F.lit("| kind | source | target | at | by |\n|---|---|---|---|---|\n"), row).alias("content"),
        F.concat(F.lit("relations/"), F.col("relation_id").cast("string"), F.lit(".md")).alias("file_path"), custom.alias("custom"), nz("repository_id").alias("repository_id"),
    )


ENTITIES = """
WITH ent AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY indexed_at DESC) AS rn FROM code_entities) WHERE rn = 1
), sym AS (SELECT * FROM ent WHERE kind = 'symbol'), rel AS (
  SELECT relation_id, any_value(kind) AS kind, any_value(regexp_extract(source_entity_id, '^code:[^:]*:([^#]*)#', 1)) AS source,
    any_value(CASE WHEN coalesce(target_id, '') <> '' THEN regexp_extract(trim(target_id, ' '), '^code:[^:]*:([^#]*)#', 1) ELSE coalesce(target_ref, '') END) AS target,
    any_value(file_path) AS file_path, any_value(line_no) AS line_no, any_value(provenance) AS provenance
  FROM code_relations GROUP BY relation_id
)
"""
