"""Queries on context packs and their parts, with SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.operators import context, rank
from marrow.plans.knowledge import _C, _ORDER, _SYMBOLS, _hits
from marrow.plans.tables import relation_concepts, symbol_concepts, table

QUESTIONS = ((0, "registry"), (1, "harbor"), (2, "snapshot"), (3, "load"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", context.token_estimate(F.col("text")).alias("tokens"))


def snippet_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 to 5 of every text, within twenty tokens."""
    got = context.range_snippet(F.col("text"), F.lit(3), F.lit(5), F.lit(20))
    return _documents(spark, sf_dir).select("doc_id", got.alias("snippet"))


def snippet_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = context.keyword_line(F.col("text"), "Registry")
    return _documents(spark, sf_dir).select("doc_id", at.alias("line")).where("line > 0")


def lines_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", context.lines_outside(F.col("text"), F.lit(2), F.lit(4)).alias("n"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "source_files").where("content is not null and file_path is not null")
    # one text for each path: the newest
    newest = f.groupBy("file_path").agg(F.max(F.struct("modified_at", "source_id")).alias("k")).select("file_path", F.col("k.source_id").alias("source_id"))
    return f.join(newest, ["file_path", "source_id"], "left_semi").select(F.col("file_path").alias("path"), "content")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_concepts(spark, sf_dir).unionByName(relation_concepts(spark, sf_dir))


def context_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four questions over the symbols, with their neighbours along the relations, 600 tokens each."""
    return context.packs(_graph(spark, sf_dir), _sources(spark, sf_dir), QUESTIONS, 600, include_relations=True)


def relation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = _graph(spark, sf_dir)
    best = rank.best_of_each(rank.many(symbol_concepts(spark, sf_dir), QUESTIONS), context.MOST_CANDIDATES)
    return context.neighbours(best, concepts).select("query_id", "rank", "slot", "source_path", "title", "reason", "score")


QUERIES = {f.__name__: f for f in (token_estimate, snippet_range, snippet_keyword, lines_outside, context_packs, relation_neighbours)}

_DOC = "WITH d AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents)"
_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(12288)"
_BLANK = f"trim({{0}}, {_WS}) = ''"
# Concepts of symbols and of relations, as one table for SQL.
_BOTH = _SYMBOLS.replace("kb AS (", "sk AS (") + """, rw AS (SELECT relation_id, coalesce(kind, '') AS kind, source AS src, target AS tgt, coalesce(file_path, '') || ':' || coalesce(line_no, 0) AS place, coalesce(provenance, '') AS prov FROM rel),
kb AS (SELECT * FROM sk UNION ALL SELECT relation_id, 'code_relation', kind || ' ' || relation_id, '', '', 'relations/' || relation_id || '.md',
  '| kind | source | target | at | by |' || chr(10) || '|---|---|---|---|---|' || chr(10) || '| ' || kind || ' | `' || src || '` | `' || tgt || '` | `' || place || '` | ' || prov || ' |', MAP {'relation_kind': kind, 'relation_source': src, 'relation_target': tgt} FROM rw)
"""


def _graph_hits(q: str) -> str:
    """Hits of a question, with what relations add to the signals of other concepts."""
    has = {n: f"contains(lower({_C.format('relation_' + n)}), {q})" for n in ("kind", "source", "target")}
    more = f"(CASE WHEN {has['kind']} THEN 25 ELSE 0 END) + (CASE WHEN {has['source']} THEN 45 ELSE 0 END) + (CASE WHEN {has['target']} THEN 45 ELSE 0 END)"
    why = "".join(f"CASE WHEN {has[n]} THEN 'relation {n} match' END, " for n in has)
    hits = _hits(q)
    hits = hits.replace(" AS score", f" + {more} AS score", 1).replace(" AS exactness", f" AS exactness_, greatest(exactness_, CASE WHEN {has['source']} OR {has['target']} THEN 60 ELSE 0 END) AS exactness", 1)
    return hits.replace("CASE WHEN contains(lower(description)", why + "CASE WHEN contains(lower(description)").replace(f"+ ({why}", "+ (")


def _asked(hits) -> str:  # noqa: ANN001
    return " UNION ALL ".join(f"SELECT {i}::INTEGER AS query_id, * FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM ({hits(repr(q))}) WHERE score > 0) WHERE rank <= {context.MOST_CANDIDATES}" for i, q in QUESTIONS)


# Neighbours of hits: relations whose source or target is the hit's path, in order, with the concept that stands for the other end.
_NEAR = f"""
, known AS (SELECT *, 'relations/' || relation_id || '.md' AS rp FROM rw WHERE kind <> ''),
ending AS (SELECT *, src AS stop FROM known UNION SELECT *, tgt FROM known),
best AS (SELECT path AS source_path, title, start_line, end_line, concept_path, provenance FROM (SELECT custom['source_path'] AS path, title, coalesce(try_cast(custom['start_line'] AS INTEGER), 0) AS start_line, coalesce(try_cast(custom['end_line'] AS INTEGER), 0) AS end_line, file_path AS concept_path,
  CASE WHEN trim(custom['provenance']) <> '' THEN custom['provenance'] ELSE 'kb.code' END AS provenance, row_number() OVER (PARTITION BY custom['source_path'] ORDER BY coalesce(try_cast(custom['start_line'] AS INTEGER), 0), title, file_path) AS k FROM sk WHERE custom['source_path'] <> '') WHERE k = 1),
met AS (SELECT query_id, rank, score - 1 AS score, kind, src, tgt, rp, relation_id, CASE WHEN tgt = stop THEN src ELSE tgt END AS other FROM ending JOIN hit ON hit.source_path = stop WHERE stop <> ''),
near AS (SELECT * FROM (SELECT query_id, rank, score, 'relation ' || kind || ' from ' || src || ' to ' || tgt AS reason, best.*, row_number() OVER (PARTITION BY query_id, rank ORDER BY kind, tgt, rp, relation_id) AS slot FROM met JOIN best ON best.source_path = other) WHERE slot <= {context.MOST_NEIGHBOURS})
"""
# Candidates in order, their ranges merged one after another, then packed one after another into the budget.
_TEXT_OF = "rtrim(array_to_string(lines[{a} + 1:{b} + 1], chr(10)), chr(10))"
_PACKS = f"""
, every AS (SELECT query_id, rank, 0 AS slot, title, type, source_path AS path, start_line AS a, end_line AS b, score, reason, provenance FROM hit UNION ALL SELECT query_id, rank, slot, title, 'code_symbol', source_path, start_line, end_line, score, reason, provenance FROM near),
fresh AS (SELECT *, row_number() OVER (PARTITION BY query_id, path, a, b ORDER BY rank, slot) AS seen FROM every),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, slot) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM fresh WHERE slot = 0 OR seen = 1),
mg AS (
  SELECT query_id, 1::BIGINT AS k, []::STRUCT(path VARCHAR, a INTEGER, b INTEGER, rel BOOLEAN, n INTEGER, why VARCHAR[], k BIGINT)[] AS done FROM cand WHERE k = 1
  UNION ALL SELECT query_id, k + 1, CASE WHEN pos = 0 THEN list_append(done, struct_pack(path := path, a := a, b := b, rel := rel, n := 1, why := CASE WHEN reason = '' THEN []::VARCHAR[] ELSE [reason] END, k := k))
    ELSE list_transform(range(1, len(done) + 1), lambda i: CASE WHEN i = pos THEN struct_pack(path := done[i].path, a := CASE WHEN done[i].a <= 0 THEN a ELSE least(done[i].a, a) END, b := greatest(done[i].b, b), rel := false, n := done[i].n + 1,
      why := CASE WHEN reason = '' OR list_contains(done[i].why, reason) THEN done[i].why ELSE list_append(done[i].why, reason) END, k := done[i].k) ELSE done[i] END) END
  FROM (SELECT mg.query_id, mg.k, done, path, a::INTEGER AS a, b::INTEGER AS b, slot > 0 AS rel, reason,
      CASE WHEN slot = 0 AND path <> '' AND a > 0 AND b > 0 THEN coalesce(list_position(list_transform(done, lambda m: NOT m.rel AND m.path = cand.path AND cand.a <= m.b + 1 AND m.a <= cand.b + 1), true), 0) ELSE 0 END AS pos
    FROM mg JOIN cand ON cand.query_id = mg.query_id AND cand.k = mg.k AND cand.k <= {context.MOST_CANDIDATES})
),
merged AS (SELECT query_id, unnest(done) AS m, unnest(range(len(done))) AS k, len(done) AS n FROM mg QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY mg.k DESC) = 1 AND mg.k = max(mg.k) OVER (PARTITION BY query_id)),
newest AS (SELECT file_path AS path, arg_max(content, (modified_at, source_id)) AS content FROM source_files WHERE content IS NOT NULL AND file_path IS NOT NULL GROUP BY 1),
mc AS (SELECT merged.query_id, merged.k, merged.n, m.path AS path, m.a AS a, m.b AS b, title, type, score, provenance, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS lines,
    CASE WHEN m.rel OR m.n = 1 THEN array_to_string(m.why, '; ') ELSE 'merged ' || m.n || ' hits: ' || array_to_string(m.why, '; ') END AS reason
  FROM merged JOIN cand ON cand.query_id = merged.query_id AND cand.k = m.k LEFT JOIN newest ON newest.path = m.path),
pk AS (
  SELECT query_id, -1::BIGINT AS k, 0::BIGINT AS used, false AS stop, '' AS omission, 0::BIGINT AS omitted, false AS item, '' AS snippet, 0::BIGINT AS first, 0::BIGINT AS last, 0::BIGINT AS tokens FROM mc WHERE k = 0
  UNION ALL SELECT query_id, k, used + CASE WHEN got THEN est ELSE 0 END, full_, CASE WHEN full_ THEN 'budget_exceeded' WHEN path = '' THEN 'no_source_path' WHEN lines IS NULL THEN 'source_missing' WHEN NOT got THEN 'snippet_empty' WHEN outside > 0 THEN 'snippet_truncated' ELSE '' END,
    CASE WHEN full_ THEN n - k WHEN got THEN outside ELSE 1 END, NOT full_ AND path <> '' AND (lines IS NULL OR got), CASE WHEN got THEN text ELSE '' END, CASE WHEN got THEN la + 1 ELSE a END, CASE WHEN got THEN lb + 1 ELSE b END, CASE WHEN got THEN est ELSE 0 END
  FROM (SELECT *, (NOT full_ AND path <> '' AND lines IS NOT NULL AND coalesce(text, '') <> '' AND est <= 600 - used) AS got, len(list_filter(range(len(lines)), lambda i: (i < la OR i > lb) AND NOT {_BLANK.format("lines[i + 1]")})) AS outside
    FROM (SELECT *, CASE WHEN wide_est <= 600 - used THEN wa ELSE ca END AS la, CASE WHEN wide_est <= 600 - used THEN wb ELSE cb END AS lb, {_TEXT_OF.format(a="la", b="lb")} AS text, ceil(length(text) / 4.0)::BIGINT AS est
      FROM (SELECT pk.query_id, mc.k, mc.n, pk.used, path, a, b, lines, pk.used >= 600 AS full_, greatest(a - 1, 0) AS ca, least(b, len(lines)) - 1 AS cb, greatest(a - 2, 0) AS wa,
          CASE WHEN b < len(lines) AND NOT {_BLANK.format("lines[b + 1]")} THEN b ELSE least(b, len(lines)) - 1 END AS wb, ceil(length({_TEXT_OF.format(a="wa", b="wb")}) / 4.0)::BIGINT AS wide_est
        FROM pk JOIN mc ON mc.query_id = pk.query_id AND mc.k = pk.k + 1 WHERE NOT pk.stop)))
),
steps AS (SELECT pk.*, mc.path, mc.title, mc.type, mc.score, mc.provenance, mc.lines, mc.reason FROM pk JOIN mc USING (query_id, k)),
omissions AS (SELECT query_id, -1::BIGINT AS k, 'candidate_limit_exceeded' AS reason, '' AS title, '' AS path, n - {context.MOST_CANDIDATES} AS c FROM cand WHERE k = 1 AND n > {context.MOST_CANDIDATES} UNION ALL SELECT query_id, k, omission, title, path, omitted FROM steps WHERE omission <> '')
SELECT query_id, 'item' AS kind, (row_number() OVER (PARTITION BY query_id ORDER BY k) - 1)::INTEGER AS seq, reason, title, type, path AS source_path,
  CASE WHEN first <= 0 THEN path WHEN last <= 0 OR last = first THEN path || ':' || first ELSE path || ':' || first || '-' || last END AS location, first::INTEGER AS start_line, last::INTEGER AS end_line, snippet, tokens::INTEGER AS tokens, score::INTEGER AS score, CASE WHEN lines IS NULL THEN provenance ELSE 'repo.source' END AS provenance FROM steps WHERE item
UNION ALL SELECT query_id, 'omission', row_number() OVER (PARTITION BY query_id ORDER BY k) - 1, reason, title, '', path, '', 0, 0, '', c, 0, '' FROM omissions"""
SQL = {
    "context_packs": _BOTH.replace("WITH", "WITH RECURSIVE", 1) + f", hit AS ({_asked(_graph_hits)})" + _NEAR + _PACKS,
    "relation_neighbours": _BOTH.replace("kb AS (SELECT * FROM sk UNION", "bare AS (SELECT * FROM sk UNION") + f", kb AS (SELECT * FROM sk), hit AS ({_asked(_hits)})" + _NEAR + "SELECT query_id, rank, slot, source_path, title, reason, score FROM near",
    "token_estimate": "SELECT doc_id, ceil(length(coalesce(text, '')) / 4.0)::INTEGER AS tokens FROM documents",
    "snippet_range": _DOC + f""", e AS (SELECT *, len(l) AS n, CASE WHEN len(l) >= 6 AND NOT {_BLANK.format("l[6]")} THEN 6 ELSE least(5, len(l)) END AS b FROM d),
c AS (SELECT doc_id, n, rtrim(array_to_string(l[2:b], chr(10)), chr(10)) AS wide, rtrim(array_to_string(l[3:least(5, n)], chr(10)), chr(10)) AS core FROM e),
p AS (SELECT doc_id, n, CASE WHEN ceil(length(wide) / 4.0) <= 20 THEN wide ELSE core END AS s FROM c)
SELECT doc_id, CASE WHEN n < 2 OR ceil(length(s) / 4.0) > 20 THEN '' ELSE s END AS snippet FROM p""",
    "snippet_keyword": _DOC + "SELECT doc_id, line FROM (SELECT doc_id, list_position(list_transform(l, lambda x: contains(lower(x), 'registry')), true)::INTEGER AS line FROM d) WHERE line > 0",
    "lines_outside": _DOC + f", x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM d) SELECT doc_id, count(*) FILTER ((i < 2 OR i > 4) AND NOT {_BLANK.format('t')})::INTEGER AS n FROM x GROUP BY doc_id",
}
