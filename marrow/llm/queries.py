"""Queries over the operators of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.llm import bpe, cooccur, docpairs, packing, spans, splitter


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _budget(spark: SparkSession, sf_dir: str, purpose: str) -> tuple[int, int]:
    row = _t(spark, sf_dir, "budgets").where(F.col("purpose") == purpose).select("size_limit", "overlap_size").first()
    return int(row[0]), int(row[1])


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description: signature, qualified name and documentation of every documented function."""
    return docpairs.documented_functions(_t(spark, sf_dir, "source_files"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pairs(spark, sf_dir).select("source_id", "qualified_name", "start_line").distinct()


def p2_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of tags that stands together in five concepts or more, with how far that exceeds chance."""
    out = cooccur.together(_t(spark, sf_dir, "concepts"))
    return out.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.unusually_often(_t(spark, sf_dir, "concepts")).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, overlap = _budget(spark, sf_dir, "concept_piece")
    return splitter.split_oversized(_t(spark, sf_dir, "concepts"), limit, overlap, text=True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, overlap = _budget(spark, sf_dir, "concept_piece")
    return splitter.split_oversized(_t(spark, sf_dir, "concepts"), limit, overlap).where("piece_no = 1").select("ord")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_t(spark, sf_dir, "documents"))


def _pack(purpose: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        capacity, _ = _budget(spark, sf_dir, purpose)
        return packing.pack_texts(_t(spark, sf_dir, "documents"), capacity)

    return run


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the small containers are."""
    capacity, _ = _budget(spark, sf_dir, "small_container")
    return packing.fill_report(packing.pack_texts(_t(spark, sf_dir, "documents"), capacity), capacity)


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(_t(spark, sf_dir, "documents"))


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(_t(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_documents(_t(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p2_found": p2_found,
    "p2_lift": p2_lift,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p6_ids": p6_ids,
    "p7_pack_small": _pack("small_container"),
    "p7_pack_large": _pack("large_container"),
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p8_share": p8_share,
}

_PAIRS = r"""
WITH latest AS (
  SELECT ord, arg_max(tags, loaded_at) AS tags FROM concepts GROUP BY ord
), tagged AS (
  SELECT DISTINCT ord, trim(regexp_replace(lower(tag), '[\s\-_]+', '-', 'g'), '-') AS tag
  FROM (SELECT ord, unnest(tags) AS tag FROM latest) WHERE tag IS NOT NULL
), t AS (SELECT * FROM tagged WHERE tag <> ''),
one AS (SELECT tag, count(*) AS n FROM t GROUP BY tag),
total AS (SELECT count(*) AS n FROM latest),
two AS (
  SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM t a JOIN t b ON a.ord = b.ord AND a.tag < b.tag GROUP BY 1, 2 HAVING count(*) >= 5
), pairs AS (
  SELECT tag_a, tag_b, n_ab, oa.n AS n_a, ob.n AS n_b, total.n AS n
  FROM two JOIN one oa ON oa.tag = tag_a JOIN one ob ON ob.tag = tag_b CROSS JOIN total
)
"""

# Boundaries of all kinds as lists of offsets, and pieces cut one after another by recursion.
_PIECES = r"""
WITH RECURSIVE cap AS (SELECT size_limit::BIGINT AS l, overlap_size::BIGINT AS o FROM budgets WHERE purpose = 'concept_piece'),
latest AS (SELECT ord, arg_max(content, loaded_at) AS content, regexp_extract(coalesce(arg_max(file_path, loaded_at), ''), '[^/]*$') AS base FROM concepts WHERE ord IS NOT NULL GROUP BY ord),
item AS (SELECT ord, content, length(content)::BIGINT AS n, CASE WHEN lower(regexp_extract(base, '[^.]*$')) IN ({code}) THEN 'code' WHEN lower(regexp_extract(base, '[^.]*$')) IN ({lines}) THEN 'lines' ELSE 'prose' END AS kind FROM latest WHERE length(content) > (SELECT l FROM cap)),
row0 AS (SELECT ord, kind, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM item),
line AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p, max(i) OVER (PARTITION BY ord) AS most FROM row0),
filled AS (SELECT *, i - lag(i) OVER (PARTITION BY ord ORDER BY i) > 1 AS after FROM line WHERE regexp_matches(t, '[^{ws}]')),
fence AS (SELECT ord, list(p) AS marks FROM line WHERE regexp_matches(t, '^[ \t]{{0,3}}(```+|~~~+)') GROUP BY ord),
placed AS (
  SELECT filled.ord, kind, CASE kind WHEN 'code' THEN 2 WHEN 'prose' THEN 2 END AS lvl, p FROM filled WHERE after AND kind <> 'lines'
  UNION ALL SELECT ord, kind, 1, p FROM filled WHERE after AND kind = 'code' AND NOT regexp_matches(t, '^[{ws}}})\]]')
  UNION ALL SELECT ord, kind, 1, p FROM line WHERE kind = 'prose' AND regexp_matches(t, '^#{{1,6}}[ \t]')
), kept AS (SELECT placed.ord, lvl, p FROM placed LEFT JOIN fence USING (ord) WHERE kind <> 'prose' OR marks IS NULL OR len(list_filter(marks, lambda x: x < p)) % 2 = 0),
said AS (SELECT ord, unnest(regexp_extract_all(content, '{sentence}|[^.!?;。！？；]+|(?s:.)')) AS t, unnest(range(1, len(regexp_extract_all(content, '{sentence}|[^.!?;。！？；]+|(?s:.)')) + 1)) AS i FROM item),
word AS (SELECT ord, unnest(regexp_extract_all(content, '[{ws}]+|[^{ws}]+')) AS t, unnest(range(1, len(regexp_extract_all(content, '[{ws}]+|[^{ws}]+')) + 1)) AS i FROM item),
bound AS (
  SELECT ord, lvl, p FROM kept UNION ALL SELECT ord, 3, p FROM line WHERE i > 1
  UNION ALL SELECT ord, 4, e FROM (SELECT *, sum(length(t)) OVER (PARTITION BY ord ORDER BY i)::BIGINT AS e FROM said) WHERE regexp_full_match(t, '{sentence}')
  UNION ALL SELECT ord, 5, e FROM (SELECT *, sum(length(t)) OVER (PARTITION BY ord ORDER BY i)::BIGINT AS e FROM word) WHERE regexp_matches(t, '^[{ws}]')
),
lists AS (SELECT ord, any_value(content) AS content, any_value(n) AS n, any_value(kind) AS kind, {lists} FROM item LEFT JOIN bound USING (ord) GROUP BY ord),
step AS (
  SELECT ord, -1::BIGINT AS piece_no, 0::BIGINT AS start, 0::BIGINT AS stop, '' AS boundary, 0::BIGINT AS next FROM lists
  UNION ALL SELECT ord, piece_no + 1, next, CASE WHEN n - next <= l THEN n ELSE cut END, CASE WHEN n - next <= l THEN 'end' ELSE name END, CASE WHEN n - next <= l THEN -1 ELSE cut - o END
  FROM (SELECT *, CASE WHEN m1 > low THEN m1 WHEN m2 > low THEN m2 WHEN m3 > low THEN m3 WHEN m4 > low THEN m4 WHEN m5 > low THEN m5 WHEN far > next + o THEN far ELSE CASE WHEN high - back > low THEN high - back ELSE high END END AS cut,
      CASE WHEN m1 > low THEN names[1] WHEN m2 > low THEN names[2] WHEN m3 > low THEN 'line' WHEN m4 > low THEN 'sentence' WHEN m5 > low THEN 'word' WHEN far > next + o THEN CASE far WHEN m1 THEN names[1] WHEN m2 THEN names[2] WHEN m3 THEN 'line' WHEN m4 THEN 'sentence' ELSE 'word' END ELSE 'hard' END AS name
    FROM (SELECT *, greatest(coalesce(m1, 0), coalesce(m2, 0), coalesce(m3, 0), coalesce(m4, 0), coalesce(m5, 0)) AS far, CASE kind WHEN 'code' THEN ['declaration', 'blank_line'] ELSE ['heading', 'paragraph'] END AS names,
        coalesce(list_filter(range(0, 60), lambda k: NOT ((substring(content, high - k + 1, 1) = chr(10) AND substring(content, high - k, 1) = chr(13)) OR regexp_matches(substring(content, high - k + 1, 1), '^[\p{{Mn}}\x{{200d}}\x{{fe0f}}]$') OR substring(content, high - k, 1) = chr(8205)))[1], 0) AS back
      FROM (SELECT step.ord, piece_no, next, content, n, kind, l, o, next + greatest(o, l // 2) AS low, next + l AS high, {lasts} FROM step JOIN lists USING (ord), cap WHERE next >= 0)))
)
SELECT step.ord, piece_no::INTEGER AS piece_no, start::INTEGER AS start, (stop - start)::INTEGER AS length, boundary, substring(content, start + 1, stop - start) AS piece FROM step JOIN lists USING (ord) WHERE piece_no >= 0
"""


def _pieces() -> str:
    quoted = lambda xs: ", ".join(f"'{x}'" for x in sorted(xs))
    return _PIECES.format(
        code=quoted(splitter.CODE),
        lines=quoted(splitter.LINES),
        ws=r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}",
        sentence=r"""(?:[.!?;]["'')\]]*[ \t]+|[。！？；][”’」』）]*)""",
        lists=", ".join(f"coalesce(list(p ORDER BY p) FILTER (lvl = {k}), []) AS l{k}" for k in range(1, 6)),
        lasts=", ".join(f"list_max(list_filter(l{k}, lambda x: x <= next + l)) AS m{k}" for k in range(1, 6)),
    )


# Every window of 200 characters of every text, those that stand in more than one document, and the runs that they make.
_SPANS = """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) >= 200),
w AS (SELECT doc_id, i, md5_number(substring(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, n - 198)) AS i FROM d)),
common AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT DISTINCT doc_id, i FROM w WHERE h IN (SELECT h FROM common)),
run AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
span AS (SELECT doc_id, (min(i) - 1)::INTEGER AS span_start, (max(i) - min(i) + 200)::INTEGER AS span_length FROM run GROUP BY doc_id, g)
"""

SQL: dict[str, str] = {
    "p3_pieces": _pieces(),
    "p8_found": _SPANS + "SELECT DISTINCT doc_id FROM span",
    "p8_spans": _SPANS + "SELECT doc_id, span_start, span_length FROM span",
    "p8_share": _SPANS + """, fresh AS (SELECT *, greatest(0, span_start + span_length - greatest(span_start, coalesce(max(span_start + span_length) OVER (PARTITION BY doc_id ORDER BY span_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS f FROM span),
c AS (SELECT doc_id, count(*) AS n_spans, sum(f)::BIGINT AS shared_chars FROM fresh GROUP BY doc_id)
SELECT doc_id, length(coalesce(text, '')) AS n_chars_now, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(coalesce(text, '')) > 0 THEN round(coalesce(shared_chars, 0) / length(text), 6) ELSE 0.0 END AS shared_share
FROM documents LEFT JOIN c USING (doc_id)""",
    "p2_found": _PAIRS + "SELECT tag_a, tag_b FROM pairs WHERE n_ab * n >= 3 * n_a * n_b",
    "p2_lift": _PAIRS + "SELECT tag_a, tag_b, n_ab, n_a, n_b, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift FROM pairs",
    "p3_found": "SELECT DISTINCT ord FROM concepts WHERE length(content) > (SELECT size_limit FROM budgets WHERE purpose = 'concept_piece')",
}
