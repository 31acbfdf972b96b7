"""Relevance of concepts for a query: eleven signals, a total order, the best few.

The score is a sum of conditional weights, the order ends with ``ord``, and the limit makes Spark keep only the best
of each task. Several queries at once share one scan of the concepts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions.text import SPACE, fold, norm_key, nz, ufold, utrim
from marrow.operators.predicates import custom, source_path

# Fixed weights of the signals: (score, exactness, reason).
EXACT_SYMBOL = (120, 100, "exact symbol match")
QUALIFIED = (70, 70, "qualified symbol match")
EXACT_TITLE = (80, 90, "exact title match")
TITLE = (40, 50, "title match")
RESOURCE = (50, 0, "resource match")
SYMBOL_KIND = (25, 0, "symbol kind match")
RELATION_KIND = (25, 0, "relation kind match")
RELATION_SOURCE = (45, 60, "relation source match")
RELATION_TARGET = (45, 60, "relation target match")
DESCRIPTION = (30, 0, "description match")
CONTENT = (10, 0, "content match")
TYPE_RANK = {"code_symbol": 40, "code_relation": 30, "code_relation_index": 30, "code_file": 20}
MOST_SCORE = 1000
#: First part of the names of origins, such as kb.code; set it to keep names that other tools gave.
NAMESPACE = "kb"


#: What the signals are tested on, folded.
_FIELDS = ("symbol_kind", "relation_kind", "relation_source", "relation_target", "qualified_name")


def _folded(name: str) -> Column:
    return norm_key(custom(name)) if name in _FIELDS else ufold(nz(name))


def signals(q: Column, folded=_folded) -> list[tuple[Column, tuple[int, int, str]]]:  # noqa: ANN001
    """Conditions in the order of their reasons; ``q`` is the folded, trimmed query, ``folded`` gives a folded field."""
    title, qualified = folded("title"), folded("qualified_name")
    exact_symbol, exact_title = (qualified == q) | (title == q), title == q

    def field(name: str) -> Column:
        return (folded(name) != "") & folded(name).contains(q)

    return [
        (exact_symbol, EXACT_SYMBOL),
        (~exact_symbol & (qualified != "") & qualified.contains(q), QUALIFIED),
        (exact_title, EXACT_TITLE),
        (~exact_title & title.contains(q), TITLE),
        (folded("resource").contains(q), RESOURCE),
        (field("symbol_kind"), SYMBOL_KIND),
        (field("relation_kind"), RELATION_KIND),
        (field("relation_source"), RELATION_SOURCE),
        (field("relation_target"), RELATION_TARGET),
        (folded("description").contains(q), DESCRIPTION),
        (folded("content").contains(q), CONTENT),
    ]


def _totals(found: list) -> tuple[Column, Column, Column]:
    """Score, exactness and reason of the conditions that hold."""
    total = sum((F.when(c, w[0]).otherwise(0) for c, w in found[1:]), F.when(found[0][0], found[0][1][0]).otherwise(0))
    exact = F.greatest(*(F.when(c, w[1]).otherwise(0) for c, w in found if w[1]))
    reason = F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(w[2])) for c, w in found))), ", ")
    return F.least(total, F.lit(MOST_SCORE)), exact, reason


def type_rank() -> Column:
    out = None
    for t, r in TYPE_RANK.items():
        out = F.when(F.col("type") == t, r) if out is None else out.when(F.col("type") == t, r)
    return out.otherwise(10)


def provenance() -> Column:
    own = custom("provenance")
    return F.when(utrim(own) != "", own).when(nz("type").startswith("code_"), F.lit(NAMESPACE + ".code")).otherwise(F.lit(NAMESPACE + ".markdown"))


def whole_number(key: str) -> Column:
    """A custom field as a number: its leading digits; 0 if it has none."""
    digits = F.regexp_extract(custom(key), r"\A[ \t\n\r]*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def truth(key: str) -> Column:
    return ufold(custom(key)) == "true"


def location(path: Column, start: Column, end: Column) -> Column:
    return (
        F.when(path == "", "")
        .when(start <= 0, path)
        .when((end <= 0) | (end == start), F.concat(path, F.lit(":"), start.cast("string")))
        .otherwise(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))
    )


def scored(concepts: DataFrame, q: Column | str) -> DataFrame:
    """``concepts`` with score, exactness and reason; rows that score nothing are dropped."""
    q = F.lit(fold(q.strip(SPACE))) if isinstance(q, str) else q
    score, exactness, reason = _totals(signals(q))
    return concepts.withColumn("score", score).where("score > 0").withColumn("exactness", exactness).withColumn("reason", reason)


def hits(scored_concepts: DataFrame) -> DataFrame:
    """The columns of a result row, with the sort keys that are not part of it (exactness, type_rank)."""
    s, e = whole_number("start_line"), whole_number("end_line")
    own = [c for c in ("query_id", "source_rank") if c in scored_concepts.columns]
    rank = [] if "source_rank" in own else [whole_number("source_rank").alias("source_rank")]
    rows = scored_concepts.select(
        *own, *rank, "ord", nz("title").alias("title"), nz("type").alias("type"), nz("resource").alias("resource"), source_path().alias("source_path"), nz("file_path").alias("concept_path"),
        s.alias("start_line"), e.alias("end_line"), *(custom(k).alias(k) for k in ("symbol_kind", "qualified_name", "relation_kind", "relation_source", "relation_target", "generator")),
        truth("generated").alias("generated"), provenance().alias("provenance"), "score", "reason", "exactness", type_rank().alias("type_rank"),
    )
    return rows.withColumn("location", location(F.col("source_path"), F.col("start_line"), F.col("end_line")))


def order() -> list[Column]:
    """Byte order of strings; ``ord`` last makes it total."""
    return [F.desc("score"), F.desc("exactness"), F.asc("source_rank"), F.desc("type_rank"), F.asc("source_path"), F.asc("start_line"), F.asc("title"), F.asc("concept_path"), F.asc("ord")]


def ranked(concepts: DataFrame, query: str, limit: int = 0, where: Column | None = None) -> DataFrame:
    """Result rows with ``rank`` from 1; all of them if ``limit`` is 0.

    With a limit Spark keeps the best of each task and numbers ``limit`` rows; without, the number is given by the
    position in the sorted result.
    """
    rows = hits(scored(concepts if where is None else concepts.where(where), query))
    if limit < 0:
        raise ValueError("limit must not be negative")
    if limit:
        return with_rank(rows.orderBy(*order()).limit(limit))
    return numbered(rows.orderBy(*order()), "rank")


def with_rank(best: DataFrame) -> DataFrame:
    """Rows that a limit has made few, numbered in order."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order())))


def numbered(sorted_rows: DataFrame, name: str) -> DataFrame:
    """Positions from 1 of rows that are sorted over partitions, without gathering them in one: sizes of the partitions are summed first."""
    spark = sorted_rows.sparkSession
    from marrow.functions.session import written

    # the part and the position in it are fixed once and written; the sizes of the parts are one row per part
    parts = written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r[0]: r[1] for r in parts.groupBy(part.alias("p")).count().collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    if not before:
        return parts.drop("_at").withColumn(name, F.lit(0))
    starts = spark.createDataFrame(before, "p long, before long")
    joined = parts.withColumn("p", part.cast("long")).join(F.broadcast(starts), "p")  # one row per partition
    return joined.withColumn(name, (F.col("before") + at + 1).cast("long")).drop("p", "before", "_at")


def many(concepts: DataFrame, queries: Sequence[tuple[int, str]]) -> DataFrame:
    """Result rows of each of several (query_id, text), in one scan of the concepts.

    The queries are a constant of the plan, so a concept is folded once and meets all of them where it is read.
    """
    table = F.array(*(F.struct(F.lit(i).alias("query_id"), F.lit(fold(t.strip(SPACE))).alias("q")) for i, t in queries))
    names = ("title", "resource", "description", "content", *_FIELDS)
    # a generator keeps the optimizer from folding again for every query
    once = concepts.withColumn("_f", F.explode(F.array(F.struct(*(_folded(n).alias(n) for n in names)))))
    each = once.withColumn("_q", F.explode(table))
    score, exactness, reason = _totals(signals(F.col("_q.q"), lambda n: F.col(f"_f.{n}")))
    rows = each.withColumn("score", score).where("score > 0").withColumn("exactness", exactness).withColumn("reason", reason)
    return hits(rows.withColumn("query_id", F.col("_q.query_id")))


def best_of_each(rows: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` rows of each query; every task keeps its own best before anything is shuffled."""
    w = Window.partitionBy("query_id").orderBy(*order())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


# Fixed texts of the steps of a trace, by type.
MESSAGES = {
    "path_resolution": "resolved knowledge paths",
    "bundle_load": "loaded knowledge bundle",
    "overlay_merge": "collapsed duplicate generated concepts across overlay paths",
    "filter_application": "applied structured query filters",
    "candidate_scoring": "scored matching candidates",
    "ranking": "ordered candidates by deterministic tie-breaks",
    "primary_hits": "selected primary query hits",
}
NO_MERGES = "no overlay merges applied"


def step(kind: str, refs: Sequence[str] = (), **counts: int) -> dict:
    message = NO_MERGES if kind == "overlay_merge" and not counts.get("collapsed_duplicates") else MESSAGES[kind]
    return {"type": kind, "message": message, "counts": counts} | ({"refs": list(refs)} if refs else {})


def trace(concepts: DataFrame, query: str, limit: int, filters: dict[str, str], paths: list[str], where: Column | None = None, returned: Sequence[str] = ()) -> list[dict]:
    """The six steps of a ranked query, with counts from one pass; ``returned`` are the places of its result rows."""
    kept = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    score, _, _ = _totals(signals(F.lit(fold(query.strip(SPACE)))))
    points = F.when(kept, score).otherwise(0)
    duplicates = F.coalesce(F.size("duplicate_sources"), F.lit(0)) if "duplicate_sources" in concepts.columns else F.lit(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    r = concepts.agg(F.count("*").alias("loaded"), total(F.when(points > 0, 1).otherwise(0)).alias("matches"), F.coalesce(F.max(points), F.lit(0)).alias("top"), total(duplicates).alias("duplicates")).first()
    return [
        step("path_resolution", paths, read_paths=len(paths)),
        step("bundle_load", concepts=r["loaded"]),
        step("overlay_merge", collapsed_duplicates=r["duplicates"]),
        step("filter_application", active_filters=sum(bool(v) for v in filters.values())),
        step("candidate_scoring", matches=r["matches"]) | {"score_delta": r["top"]},
        step("ranking", returned, returned=min(limit, r["matches"]) if limit else r["matches"]),
    ]
