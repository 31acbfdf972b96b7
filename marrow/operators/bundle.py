"""Operations on a bundle of concepts: lookups by title, changes, related rows, statistics, overlays."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions.text import nz
from marrow.operators.predicates import custom
from marrow.operators.rank import numbered


@dataclass(frozen=True)
class Bundle:
    """Concepts with the few facts of their bundle."""

    concepts: DataFrame
    name: str = ""
    description: str = ""
    version: str = ""
    owner: str = ""
    root_path: str = ""

    def with_concepts(self, concepts: DataFrame) -> Bundle:
        return replace(self, concepts=concepts)


def get_concept(concepts: DataFrame, title: str) -> DataFrame:
    """The first row with a title; no row if there is none."""
    return concepts.where(nz("title") == title).orderBy("ord").limit(1)


def remove_concept(concepts: DataFrame, title: str) -> DataFrame:
    """All rows but the first with a title."""
    first = concepts.where(nz("title") == title).agg(F.min("ord").alias("ord")).where("ord is not null")
    return concepts.join(F.broadcast(first), "ord", "left_anti")  # one row


def default_path(type_: Column, title: Column) -> Column:
    """Where a concept without a path is kept."""
    folder = F.when(type_ == "", "concepts").otherwise(F.concat(type_, F.lit("s")))
    return F.concat(folder, F.lit("/"), safe_name(title), F.lit(".md"))


def safe_name(c: Column) -> Column:
    """A title as a file name: characters that paths reserve become underscores."""
    return F.translate(c, '/\\:*?"<>|', "_" * 9)


def add_concepts(concepts: DataFrame, new: DataFrame) -> DataFrame:
    """Rows appended after the last, with a path if they have none."""
    last = concepts.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("_last"))
    path = F.when(nz("file_path") == "", default_path(nz("type"), nz("title"))).otherwise(F.col("file_path"))
    placed = new.withColumn("file_path", path).withColumn("_given", F.col("ord") if "ord" in new.columns else F.monotonically_increasing_id())
    counted = numbered(placed.drop("ord").orderBy("_given"), "_n")
    shifted = counted.crossJoin(F.broadcast(last)).withColumn("ord", F.col("_n") + F.col("_last")).drop("_given", "_n", "_last")  # one row
    return concepts.unionByName(shifted, allowMissingColumns=True)


def related_keys(concepts: DataFrame) -> DataFrame:
    """(ord, key): what makes a row related to others, its distinct tags and its resource."""
    tags = F.transform(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: F.concat(F.lit("t:"), t))
    resource = F.when(nz("resource") != "", F.array(F.concat(F.lit("r:"), "resource"))).otherwise(F.array().cast("array<string>"))
    return concepts.select("ord", F.explode(F.array_compact(F.concat(tags, resource))).alias("key"))


def related_to(concepts: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_ord, ord): the other rows that share a tag or a resource with each row of ``asked``.

    Two equi-joins in one, on the keys that the asked rows have; asked rows are a stated query set against all rows.
    """
    want = related_keys(asked).withColumnRenamed("ord", "query_ord")
    have = related_keys(concepts)
    return have.join(want, "key").where("ord <> query_ord").select("query_ord", "ord").distinct()


def stats(concepts: DataFrame) -> DataFrame:
    """One row: number of concepts, of types and of tags that are used."""
    one = concepts.agg(F.count("*").alias("n_concepts"), F.countDistinct(F.when(nz("type") != "", F.col("type"))).alias("n_types"))
    tags = concepts.select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag").alias("n_tags"))
    return one.crossJoin(F.broadcast(tags))  # one row each


def type_counts(concepts: DataFrame) -> DataFrame:
    return concepts.where(nz("type") != "").groupBy("type").agg(F.count("*").alias("n"))


def tag_counts(concepts: DataFrame) -> DataFrame:
    """Occurrences of each tag, twice for a concept that lists it twice."""
    return concepts.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def overlay(*ranked: DataFrame) -> DataFrame:
    """Bundles one after the other with their rank as ``source_rank``, 0 first."""
    out = ranked[0].withColumn("source_rank", F.lit(0))
    for k, df in enumerate(ranked[1:], 1):
        out = out.unionByName(df.withColumn("source_rank", F.lit(k)), allowMissingColumns=True)
    return out


def overlay_identity() -> Column:
    """What makes two generated concepts the same; NULL for those that are never the same as others."""
    generated = F.lower(custom("generated")) == "true"
    place = F.when(nz("resource") != "", F.col("resource")).otherwise(nz("file_path"))
    parts = [custom("generator"), custom("source_path"), nz("type"), place]
    whole = generated
    for p in parts:
        whole = whole & (p != "")
    return F.when(whole, F.concat_ws("\u0000", *parts))


def collapse_overlays(concepts: DataFrame) -> DataFrame:
    """The best copy of each generated concept, with ``duplicate_sources``, the ranks and paths of the others in order."""
    keyed = concepts.withColumn("_id", F.coalesce(overlay_identity(), F.concat(F.lit("\u0001"), F.col("source_rank").cast("string"), F.lit("\u0001"), F.col("ord").cast("string"))))
    w = Window.partitionBy("_id").orderBy("source_rank", "ord")
    ranked = keyed.withColumn("_k", F.row_number().over(w))
    losers = ranked.where("_k > 1").groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_rank", "ord", "file_path"))), lambda x: F.struct(x["source_rank"].alias("source_rank"), x["file_path"].alias("file_path"))).alias("duplicate_sources"))
    return ranked.where("_k = 1").join(losers, "_id", "left").drop("_id", "_k")
