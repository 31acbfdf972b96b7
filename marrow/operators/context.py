"""Context packs: the best hits of a query, their neighbours, merged ranges, and source snippets under a token budget.

Hits, neighbours and sources are found by joins for many queries at once. What follows depends on order (each step on
the budget that earlier ones left), so the at most ``MOST_CANDIDATES`` candidates of a query are folded in one group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions.text import SPACE, clean_path, fold, nz
from marrow.operators import rank
from marrow.operators.predicates import custom, source_path

# Fixed limits of the plan.
DEFAULT_BUDGET = 4000
MOST_CANDIDATES = 50
MOST_NEIGHBOURS = 3
SOURCE_BYTES = 256 * 1024
SURROUNDING = 1
# Fixed texts of the steps of a trace, by type.
MESSAGES = {
    "relation_expansion": "expanded one-hop relation neighbors",
    "range_merge": "merged overlapping or adjacent same-file ranges",
    "omission": "omitted context candidate",
    "snippet_extraction": "extracted source snippet",
    "budget_packing": "packed context items under token budget",
}
NO_EXPANSION = "relation expansion disabled"


# --- on columns -------------------------------------------------------------------------------------------------


def token_estimate(text: Column) -> Column:
    """A token for each four characters begun."""
    return F.ceil(F.char_length(text) / 4).cast("int")


def lines(content: Column) -> Column:
    return F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")


def range_snippet(content: Column, start: Column, end: Column, budget: Column) -> Column:
    """Lines ``start`` to ``end`` with one line around, without it if that exceeds the budget, empty if even that does."""
    all_lines = lines(content)
    n = F.size(all_lines)
    first = F.greatest(start - SURROUNDING, F.lit(1))
    last = F.least(end + SURROUNDING, n)
    blank_after = (last > end) & (F.trim(F.translate(F.coalesce(F.try_element_at(all_lines, last), F.lit("")), SPACE, " " * len(SPACE))) == "")
    last = F.when(blank_after, last - 1).otherwise(last)
    cut = lambda a, b: F.rtrim(F.array_join(F.slice(all_lines, F.greatest(a, F.lit(1)), F.greatest(b - a + 1, F.lit(0))), "\n"), F.lit("\n"))
    wide, core = cut(first, last), cut(start, F.least(end, n))
    chosen = F.when(token_estimate(wide) <= budget, wide).otherwise(core)
    return F.when((start - SURROUNDING > n) | (start <= 0) | (end <= 0), "").when(token_estimate(chosen) > budget, "").otherwise(chosen)


def keyword_line(content: Column, query: str) -> Column:
    """Number of the first line that holds the query, folded; 0 if none does."""
    q = fold(query.strip(SPACE))
    hits = F.transform(lines(content), lambda x: F.lower(x).contains(q))
    return F.coalesce(F.array_position(hits, True), F.lit(0)).cast("int")


def lines_outside(content: Column, start: Column, end: Column) -> Column:
    """Lines that are not blank outside a range."""
    numbered = F.transform(lines(content), lambda x, i: F.struct((i + 1).alias("i"), x.alias("x")))
    blank = lambda x: F.trim(F.translate(x, SPACE, " " * len(SPACE))) == ""
    return F.size(F.filter(numbered, lambda s: ((s["i"] < start) | (s["i"] > end)) & ~blank(s["x"])))


# --- the fold over the candidates of one query ------------------------------------------------------------------


@dataclass
class Candidate:
    path: str
    start: int
    end: int
    hits: list[dict]
    reason_text: str = ""
    relation: bool = False

    def reason(self) -> str:
        if self.reason_text.strip():
            return self.reason_text
        unique = list(dict.fromkeys(h["reason"] for h in self.hits if h["reason"]))
        text = "; ".join(unique)
        return f"merged {len(self.hits)} hits: {text}" if len(self.hits) > 1 else text


@dataclass
class Pack:
    items: list[dict] = field(default_factory=list)
    omissions: list[dict] = field(default_factory=list)
    trace: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    used: int = 0
    omitted: int = 0
    omitted_lines: int = 0

    def omit(self, reason: str, title: str, path: str, count: int = 1) -> None:
        self.omissions.append({"reason": reason, "title": title, "source_path": path, "count": count})
        self.trace.append({"type": "omission", "message": MESSAGES["omission"], "refs": [path] if path else [], "counts": {"count": count}, "omission_reason": reason})
        self.omitted += count


def location(path: str, start: int, end: int) -> str:
    if not path or start <= 0:
        return path
    return f"{path}:{start}" if end <= 0 or end == start else f"{path}:{start}-{end}"


def expand(primaries: list[Candidate], neighbours: dict[int, list[Candidate]], trace: list[dict] | None = None) -> list[Candidate]:
    """Each primary followed by its first neighbours; a neighbour whose range was seen is left out, a primary never."""
    out: list[Candidate] = []
    seen: set[tuple[str, int, int]] = set()
    for k, p in enumerate(primaries):
        out.append(p)
        seen.add((p.path, p.start, p.end))
        fresh = []
        for n in neighbours.get(k, [])[:MOST_NEIGHBOURS]:
            if (n.path, n.start, n.end) not in seen:
                seen.add((n.path, n.start, n.end))
                fresh.append(n)
        out += fresh
        if trace is not None:
            trace.append({"type": "relation_expansion", "message": MESSAGES["relation_expansion"], "refs": [p.path], "counts": {"neighbors": len(fresh)}})
    return out


def merge_ranges(candidates: list[Candidate], trace: list[dict] | None = None) -> list[Candidate]:
    """In order, each range goes into the first earlier one of its path that it overlaps or touches; no second pass."""
    out: list[Candidate] = []
    refs: list[str] = []
    for c in candidates:
        into = None
        if c.path and c.start > 0 and c.end > 0 and not c.relation:
            # a range without lines (0) takes part like one that begins before the text
            into = next((m for m in out if not m.relation and m.path == c.path and c.start <= m.end + 1 and m.start <= c.end + 1), None)
        if into is None:
            out.append(c)
            continue
        into.start = c.start if into.start <= 0 else min(into.start, c.start)
        into.end = max(into.end, c.end)
        into.hits = into.hits + c.hits
        into.reason_text = ""
        refs.append(location(into.path, into.start, into.end))
    if trace is not None:
        trace.append({"type": "range_merge", "message": MESSAGES["range_merge"], "refs": list(dict.fromkeys(refs)), "counts": {"merges": len(refs)}})
    return out


def estimate(text: str) -> int:
    return math.ceil(len(text) / 4)


def _outside(rows: list[str], start: int, end: int) -> int:
    return sum(1 for i, x in enumerate(rows) if not start <= i <= end and x.strip(SPACE))


def snippet(content: str, query: str, start: int, end: int, budget: int) -> tuple[str, int, int, int]:
    """Text, first and last line (from 1; 0 without text) and lines left out, of a range or, without one, around the query."""
    if budget <= 0:
        return "", 0, 0, 0
    rows = content.replace("\r\n", "\n").split("\n")
    if start <= 0 or end <= 0:
        q = fold(query.strip(SPACE))
        at = next((i for i, x in enumerate(rows) if q in fold(x)), -1)
        text = _around(rows[at], q, budget) if at >= 0 else ""
        if not text:
            return "", 0, 0, _outside(rows, 0, -1)
        return text, at + 1, at + 1, _outside(rows, at, at)
    a, b = max(0, start - 1 - SURROUNDING), min(len(rows) - 1, end - 1 + SURROUNDING)
    while b > end - 1 and not rows[b].strip(SPACE):
        b -= 1
    if a > b or a >= len(rows):
        return "", 0, 0, _outside(rows, 0, -1)
    text = "\n".join(rows[a : b + 1]).rstrip("\n")
    if not text:
        return "", 0, 0, _outside(rows, a, b)
    if estimate(text) > budget:
        core_a, core_b = max(0, start - 1), min(len(rows) - 1, end - 1)
        if core_a <= core_b:
            a, b = core_a, core_b
            text = "\n".join(rows[a : b + 1]).rstrip("\n")
    if estimate(text) > budget:
        return "", 0, 0, _outside(rows, a, b)
    return text, a + 1, b + 1, _outside(rows, a, b)


def _around(line: str, q: str, budget: int) -> str:
    """A line cut around the query to four characters a token."""
    most = budget * 4
    at = fold(line).find(q) if q else -1
    if at < 0 or not line:
        return ""
    if len(line) <= most:
        return line
    if len(q) > most:
        return ""
    begin = max(0, at - (most - len(q)) // 2)
    end = min(len(line), begin + most)
    begin = max(0, end - most)
    text = line[begin:end]
    return text if q in fold(text) else ""


def safe(path: str) -> bool:
    """Whether a cleaned path stays within its repository."""
    return not (path.startswith("/") or path in (".", "..") or path.startswith("../"))


def pack(candidates: list[Candidate], sources: dict[str, str], query: str, budget: int = 0) -> Pack:
    """Candidates in order until the budget is used up; one that does not fit is passed over, smaller ones may follow."""
    budget = budget if budget > 0 else DEFAULT_BUDGET
    out = Pack()
    if len(candidates) > MOST_CANDIDATES:
        n = len(candidates) - MOST_CANDIDATES
        out.omissions.append({"reason": "candidate_limit_exceeded", "title": "", "source_path": "", "count": n})
        out.omitted += n
        candidates = candidates[:MOST_CANDIDATES]
    candidates = merge_ranges(candidates, out.trace)
    for k, c in enumerate(candidates):
        hit = c.hits[0]
        if out.used >= budget:
            out.omit("budget_exceeded", hit["title"], c.path, len(candidates) - k)
            break
        if hit.get("missing"):
            out.omit("concept_missing", hit["title"], c.path)
            continue
        if not c.path:
            out.warnings.append("no source path for " + hit["title"])
            out.omit("no_source_path", hit["title"], "")
            continue
        if not safe(c.path):
            out.warnings.append("source path escapes repository: " + c.path)
            out.omit("source_path_escapes_repo", hit["title"], c.path)
            continue
        item = {"title": hit["title"], "type": hit["type"], "source_path": c.path, "score": int(hit["score"]), "reason": c.reason()}
        if c.path not in sources:
            out.warnings.append("source file missing: " + c.path)
            out.omit("source_missing", hit["title"], c.path)
            out.items.append(item | {"location": location(c.path, c.start, c.end), "start_line": c.start, "end_line": c.end, "snippet": "", "token_estimate": 0, "provenance": hit["provenance"]})
            continue
        text, a, b, left_out = snippet(sources[c.path], query, c.start, c.end, budget - out.used)
        tokens = estimate(text)
        if not text:
            out.omit("snippet_empty", hit["title"], c.path)
            continue
        if tokens <= 0:
            out.omit("zero_token_snippet", hit["title"], c.path)
            continue
        if out.used + tokens > budget:
            out.omit("budget_exceeded", hit["title"], c.path)
            continue
        out.used += tokens
        if left_out > 0:
            out.omit("snippet_truncated", hit["title"], c.path, left_out)
            out.omitted_lines += left_out
        refs = [x for x in dict.fromkeys((location(c.path, a, b), hit.get("concept_path", ""))) if x]
        out.trace.append({"type": "snippet_extraction", "message": MESSAGES["snippet_extraction"], "refs": refs, "counts": {"tokens": tokens}})
        out.items.append(item | {"location": location(c.path, a, b), "start_line": a, "end_line": b, "snippet": text, "token_estimate": tokens, "provenance": "repo.source"})
    out.trace.append({"type": "budget_packing", "message": MESSAGES["budget_packing"], "counts": {"items": len(out.items), "used_tokens": out.used, "budget_tokens": budget, "omitted": out.omitted}})
    return out


# --- hits, neighbours and sources by joins ----------------------------------------------------------------------

_HIT = ("title", "type", "source_path", "start_line", "end_line", "score", "reason", "provenance", "concept_path")


def best_of_path(concepts: DataFrame) -> DataFrame:
    """The concept that stands for each source path: not a relation; by source rank, type, line, title, path."""
    rows = concepts.where(custom("relation_kind") == "").select(
        source_path().alias("source_path"), nz("title").alias("title"), nz("type").alias("type"), rank.whole_number("start_line").alias("start_line"), rank.whole_number("end_line").alias("end_line"),
        rank.provenance().alias("provenance"), nz("file_path").alias("concept_path"), rank.whole_number("source_rank").alias("source_rank"), rank.type_rank().alias("type_rank"), "ord",
    ).where("source_path <> ''")
    # the best of each path by an aggregate, combined in each task: no path's concepts are sorted in one place
    key = F.struct(F.col("source_rank"), (-F.col("type_rank")).alias("t"), F.col("start_line"), F.col("title"), F.col("concept_path"), F.col("ord"))
    return rows.groupBy("source_path").agg(F.min_by(F.struct("title", "type", "start_line", "end_line", "provenance", "concept_path"), key).alias("b")).select("source_path", "b.*")


def neighbours(hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query_id, rank, slot, hit columns, reason): up to three neighbours of each hit along relations, in order.

    A relation meets the hit's path as source or as target: two equi-joins, not one with an OR.
    """
    raw = concepts.where(custom("relation_kind") != "").select(
        custom("relation_kind").alias("kind"), clean_path(custom("relation_source")).alias("src"), clean_path(custom("relation_target")).alias("tgt"), custom("relation_target").alias("raw_target"), nz("file_path").alias("relation_path"), F.col("ord").alias("relation_ord")
    )
    ends = raw.select("*", F.explode(F.array_distinct(F.array("src", "tgt"))).alias("end"))
    asked = hits.where("source_path <> ''").select("query_id", "rank", F.col("source_path").alias("end"), (F.col("score") - 1).alias("score"))
    met = ends.join(asked, "end").withColumn("path", F.when(F.col("tgt") == F.col("end"), F.col("src")).otherwise(F.col("tgt")))
    # only relations whose other end has a concept count for the limit
    best = best_of_path(concepts)
    found = met.join(best.withColumnRenamed("source_path", "path"), "path")
    w = Window.partitionBy("query_id", "rank").orderBy("kind", "raw_target", "relation_path", "relation_ord")
    reason = F.concat(F.lit("relation "), "kind", F.lit(" from "), "src", F.lit(" to "), "tgt")
    return found.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= MOST_NEIGHBOURS).select("query_id", "rank", "slot", F.col("path").alias("source_path"), "title", "type", "start_line", "end_line", "score", reason.alias("reason"), "provenance", "concept_path")


RESULT = (
    "query_id int, kind string, seq int, reason string, title string, type string, source_path string, location string, start_line int, end_line int, "
    "snippet string, tokens int, score int, provenance string"
)


def packs(concepts: DataFrame, sources: DataFrame, queries: Sequence[tuple[int, str]], budget: int = 0, include_relations: bool = False, hits: DataFrame | None = None) -> DataFrame:
    """Items and omissions (``kind``) of every query; ``sources`` is (path, content), of which the first 256 KiB count."""
    best = (rank.best_of_each(rank.many(concepts, queries), MOST_CANDIDATES) if hits is None else hits).select("query_id", "rank", *_HIT)
    rows = best.withColumn("slot", F.lit(0))
    if include_relations:
        rows = rows.unionByName(neighbours(best, concepts).select("query_id", "rank", *_HIT, "slot"))
    text = sources.select(F.col("path").alias("source_path"), F.decode(F.substring(F.encode(nz("content"), "utf-8"), 1, SOURCE_BYTES), "utf-8").alias("content"))
    # a source goes once to each query that needs it, with the first of its candidates
    once = F.row_number().over(Window.partitionBy("query_id", "source_path").orderBy("rank", "slot")) == 1
    joined = rows.withColumn("once", once).join(text.withColumnRenamed("source_path", "path"), F.col("once") & (F.col("source_path") == F.col("path")), "left").drop("once", "path")
    texts = dict(queries)

    def fold_one(group: pd.DataFrame) -> pd.DataFrame:
        # at most MOST_CANDIDATES primaries and their neighbours
        group = group.sort_values(["rank", "slot"])
        query_id = int(group["query_id"].iloc[0])
        found = {r.source_path: r.content for r in group.itertuples() if r.content is not None}
        primaries, near = [], {}
        for r in group.to_dict("records"):
            c = Candidate(r["source_path"], int(r["start_line"]), int(r["end_line"]), [r], r["reason"] if r["slot"] else "", bool(r["slot"]))
            if r["slot"]:
                near.setdefault(len(primaries) - 1, []).append(c)
            else:
                primaries.append(c)
        p = pack(expand(primaries, near), found, texts[query_id], budget)
        out = [(query_id, "item", k, i["reason"], i["title"], i["type"], i["source_path"], i["location"], i["start_line"], i["end_line"], i["snippet"], i["token_estimate"], i["score"], i["provenance"]) for k, i in enumerate(p.items)]
        out += [(query_id, "omission", k, o["reason"], o["title"], "", o["source_path"], "", 0, 0, "", o["count"], 0, "") for k, o in enumerate(p.omissions)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    return joined.groupBy("query_id").applyInPandas(fold_one, RESULT)
