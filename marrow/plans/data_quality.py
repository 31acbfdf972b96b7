"""Queries on timestamps and on references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.operators import orphans, timestamps


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every concept's timestamp with its instant, or the reason why it has none."""
    got = timestamps.normalise_concepts(*(_t(spark, sf_dir, n) for n in ("concepts", "repositories", "zone_codes")))
    return got.distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = timestamps.normalise_concepts(*(_t(spark, sf_dir, n) for n in ("concepts", "repositories", "zone_codes")))
    return got.where(F.col("utc_micros").isNotNull() & F.col("ord").isNotNull()).select("ord", "utc_micros").distinct()


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [_t(spark, sf_dir, n) for n in ("code_relations", "code_entities", "library_entities")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level of the fixpoint."""
    return orphans.levels(*_tables(spark, sf_dir)).where("level = 0").select("relation_id")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.report(*_tables(spark, sf_dir))


def p5_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every orphaned relation with its level: 0 direct, above 0 inherited."""
    return orphans.levels(*_tables(spark, sf_dir))


def p5_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphaned references by the column that names their target and by level."""
    return orphans.level_counts(*_tables(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_instants": p4_instants, "p5_found": p5_found, "p5_report": p5_report, "p5_cascade": p5_cascade, "p5_levels": p5_levels}

_ORPHANS = r"""
WITH RECURSIVE lives AS (
  SELECT 'id:' || trim(entity_id) AS k, indexed_at AS f, deleted_at AS t FROM code_entities WHERE trim(entity_id) <> ''
  UNION SELECT 'ext:' || trim(external_id), indexed_at, deleted_at FROM code_entities WHERE trim(external_id) <> ''
  UNION SELECT 'id:' || trim(entity_id), NULL, NULL FROM library_entities WHERE trim(entity_id) <> ''
  UNION SELECT 'ext:' || trim(external_id), NULL, NULL FROM library_entities WHERE trim(external_id) <> ''
), stripped AS (
  SELECT relation_id, source_entity_id AS source, seen_at,
    regexp_replace(target_id, '^\s+|\s+$', '', 'g') AS i, regexp_replace(target_ref, '^\s+|\s+$', '', 'g') AS x FROM code_relations
), refs AS (
  SELECT DISTINCT relation_id, source, seen_at, CASE WHEN i <> '' THEN 'id:' || i WHEN x <> '' THEN 'ext:' || x END AS k FROM stripped
), orphan AS (
  SELECT * FROM refs WHERE k IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.k = refs.k AND (l.f IS NULL OR l.f <= seen_at) AND (l.t IS NULL OR seen_at < l.t))
)
"""
_LEVELS = """, faulty(k, level) AS (
  SELECT DISTINCT 'id:' || source, 0 FROM orphan
  UNION
  SELECT 'id:' || refs.source, level + 1 FROM refs JOIN faulty ON refs.k = faulty.k WHERE level < 40
), first_level AS (SELECT k, min(level) AS level FROM faulty GROUP BY k),
levels AS (
  SELECT relation_id, min(level) AS level FROM (
    SELECT relation_id, 0 AS level FROM orphan
    UNION ALL SELECT relation_id, level + 1 FROM refs JOIN first_level USING (k)
  ) GROUP BY relation_id
)
"""
# The same with records known by their external ids too.
_NAMED_LEVELS = """, named(source, k) AS (
  SELECT DISTINCT source, 'id:' || source FROM refs WHERE source <> ''
  UNION SELECT trim(entity_id), 'ext:' || trim(external_id) FROM code_entities WHERE trim(external_id) <> '' UNION SELECT trim(entity_id), 'ext:' || trim(external_id) FROM library_entities WHERE trim(external_id) <> ''
), faulty(k, level) AS (
  SELECT DISTINCT named.k, 0 FROM orphan JOIN named USING (source)
  UNION SELECT named.k, level + 1 FROM refs JOIN faulty ON refs.k = faulty.k JOIN named ON named.source = refs.source WHERE level < 40
), first_level AS (SELECT k, min(level) AS level FROM faulty GROUP BY k),
found AS (SELECT DISTINCT relation_id, k, 0 AS level FROM orphan UNION SELECT relation_id, k, level + 1 FROM refs JOIN first_level USING (k) WHERE relation_id NOT IN (SELECT relation_id FROM orphan))
"""
_SPANS = ", spans AS (SELECT k, min(f) AS first, max(coalesce(t, TIMESTAMP '9999-12-31')) AS last FROM lives GROUP BY k)"
# Fields of a timestamp by one pattern for each family of shapes; wall times by the zones that DuckDB has, tried at the instants around for a second reading.
_INSTANTS = r"""
WITH t AS (
  SELECT ord, arg_max(concept_ts, loaded_at) AS raw, arg_max(repository_id, loaded_at) AS rid FROM concepts WHERE ord IS NOT NULL GROUP BY ord
), c AS (
  SELECT ord, time_zone, lower(trim(date_order)) AS date_order, regexp_replace(regexp_replace(trim(coalesce(raw, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' "''`“”‘’«»' || chr(160) || chr(12288) || chr(65279) || chr(8203)), '([0-9][.,][0-9]{6})[0-9]+', '\1'), '[\t\n\r\x0b\x0c\x{a0}\x{3000}]', ' ', 'g') AS s
  FROM t LEFT JOIN (SELECT repository_id, max(time_zone) AS time_zone, max(date_order) AS date_order FROM repositories GROUP BY 1) r ON r.repository_id = rid
), shape AS (
  SELECT *,
    regexp_extract(s, '^0*([0-9]{10,})(?:\.([0-9]+))?$', ['n', 'nf']) AS e,
    regexp_extract(s, '^(?:([0-9]{4})([-/.])([0-9]{1,2})([-/.])([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})([-/.])([0-9]{4})|([0-9]{4}) ?年 ?([0-9]{1,2}) ?月 ?([0-9]{1,2}) ?日|(?:([A-Za-z]{3,9}),? )?([0-9]{1,2})(?:[A-Za-z]{2})?[ -]([A-Za-z]{3,9}),?[ -]([0-9]{4})|([A-Za-z]{3,9}) +([0-9]{1,2}),? ([0-9]{4})|([0-9]{4})-[Ww]([0-9]{2})-([0-9]))(?:([Tt]|,? )(.+))?$',
      ['y1', 's1', 'm1', 's2', 'd1', 'p', 's3', 'q', 's4', 'y2', 'y3', 'm3', 'd3', 'w4', 'd4', 'mon4', 'y4', 'mon5', 'd5', 'y5', 'y6', 'week', 'wd', 'sep', 'rest']) AS a,
    regexp_extract(s, '^([0-9]{4})([0-9]{2})([0-9]{2})(?:[Tt ]([0-9]{2})([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]+))?)?(.*))?$', ['y', 'm', 'd', 'hh', 'mi', 'ss', 'f', 'z']) AS b,
    regexp_extract(s, '^([A-Za-z]{3,9}),? ([A-Za-z]{3,9}) +([0-9]{1,2}) ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)? ([0-9]{4})(.*)$', ['w', 'mon', 'd', 'hh', 'mi', 'ss', 'f', 'y', 'z']) AS g,
    regexp_extract(s, '^([A-Za-z]{3,9}),? ([A-Za-z]{3,9}) +([0-9]{1,2}) ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)? ([+-][0-9]{2}:?[0-9]{2}|[A-Za-z]{1,5}) ([0-9]{4})$', ['w', 'mon', 'd', 'hh', 'mi', 'ss', 'f', 'z', 'y']) AS h
  FROM c WHERE s <> ''
), parts AS (
  SELECT ord, time_zone, e.n AS n, e.nf AS nf,
    CASE WHEN e.n <> '' THEN '' WHEN b.y <> '' THEN 'b' WHEN g.y <> '' THEN 'g' WHEN h.y <> '' THEN 'h' WHEN a.y1 || a.y2 || a.y3 || a.y4 || a.y5 || a.y6 <> '' AND a.s1 = a.s2 AND a.s3 = a.s4 THEN 'a' ELSE '' END AS k, a, b, g, h, date_order,
    regexp_extract(a.rest, '^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?: ?([AaPp][Mm])($|[^A-Za-z/].*)|($|[^A-Za-z0-9:.,].*|[A-Za-z].*))$', ['hh', 'mi', 'ss', 'f', 'ap', 'z1', 'z2']) AS u
  FROM shape
), fields AS (
  SELECT ord, time_zone, n, nf, k,
    CASE k WHEN 'b' THEN b.y WHEN 'g' THEN g.y WHEN 'h' THEN h.y ELSE a.y1 || a.y2 || a.y3 || a.y4 || a.y5 || a.y6 END AS y,
    CASE k WHEN 'b' THEN b.m WHEN 'g' THEN '' WHEN 'h' THEN '' ELSE a.m1 || a.m3 || CASE WHEN a.p = '' THEN '' WHEN date_order = 'dmy' THEN a.q WHEN date_order = 'mdy' OR try_cast(a.p AS INT) = try_cast(a.q AS INT) THEN a.p ELSE '99' END END AS m,
    CASE k WHEN 'b' THEN b.d WHEN 'g' THEN g.d WHEN 'h' THEN h.d ELSE a.d1 || a.d3 || a.d4 || a.d5 || CASE WHEN a.p = '' THEN '' WHEN date_order = 'dmy' THEN a.p ELSE a.q END END AS d,
    lower(CASE k WHEN 'g' THEN g.mon WHEN 'h' THEN h.mon WHEN 'a' THEN a.mon4 || a.mon5 ELSE '' END) AS mon, lower(CASE k WHEN 'g' THEN g.w WHEN 'h' THEN h.w WHEN 'a' THEN a.w4 ELSE '' END) AS w,
    CASE WHEN k = 'a' THEN a.week ELSE '' END AS week, CASE WHEN k = 'a' THEN a.wd ELSE '' END AS wd,
    CASE k WHEN 'b' THEN b.hh WHEN 'g' THEN g.hh WHEN 'h' THEN h.hh ELSE u.hh END AS hh, CASE k WHEN 'b' THEN b.mi WHEN 'g' THEN g.mi WHEN 'h' THEN h.mi ELSE u.mi END AS mi, CASE k WHEN 'b' THEN b.ss WHEN 'g' THEN g.ss WHEN 'h' THEN h.ss ELSE u.ss END AS ss,
    CASE k WHEN 'b' THEN b.f WHEN 'g' THEN g.f WHEN 'h' THEN h.f ELSE u.f END AS f, CASE WHEN k = 'a' THEN lower(u.ap) ELSE '' END AS ap,
    CASE k WHEN 'b' THEN b.z WHEN 'g' THEN g.z WHEN 'h' THEN ' ' || h.z ELSE u.z1 || u.z2 END AS z, k = 'a' AND a.rest <> '' AND u.hh = '' AS bad
  FROM parts
), dated AS (
  SELECT *, CASE WHEN mon = '' THEN try_cast(m AS INT) ELSE list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], CASE WHEN mon IN ('january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december', 'sept') OR length(mon) = 3 THEN left(mon, 3) ELSE '' END) END AS mm FROM fields WHERE k <> '' AND NOT bad
), days AS (
  SELECT *, CASE WHEN week <> '' THEN CASE WHEN try_cast(week AS INT) BETWEEN 1 AND weekofyear(make_date(try_cast(y AS BIGINT), 12, 28)) AND try_cast(wd AS INT) BETWEEN 1 AND 7 THEN date_trunc('week', make_date(try_cast(y AS BIGINT), 1, 4))::DATE + ((try_cast(week AS INT) - 1) * 7 + try_cast(wd AS INT) - 1) END
      ELSE try_cast(lpad(y, 4, '0') || '-' || lpad(mm::VARCHAR, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) END AS day,
    regexp_extract(z, '^(?: ?([+−-])([0-9]{2})(?::?([0-9]{2}))?(?: ?(?:\[[^\]]*\]|\([^)]*\)))?| ?([A-Za-z])(?: ?\[[^\]]*\])?| ([A-Za-z][A-Za-z_]*(?:/[A-Za-z_+0-9-]+)+)| ?\[([A-Za-z_/+0-9-]+)\]| ([A-Za-z]{2,5}))$', ['sign', 'oh', 'om', 'u', 'name', 'name2', 'code']) AS o
  FROM dated
), walls AS (
  SELECT *, hh = '' AS bare, CASE WHEN ap = '' THEN coalesce(try_cast(hh AS INT), 0) ELSE try_cast(hh AS INT) % 12 + CASE WHEN ap = 'pm' THEN 12 ELSE 0 END END AS h, coalesce(try_cast(mi AS INT), 0) AS mn, coalesce(try_cast(ss AS INT), 0) AS sc FROM days
  WHERE day IS NOT NULL AND (w = '' OR w IN (lower(dayname(day)), lower(dayname(day))[:3])) AND (ap = '' OR try_cast(hh AS INT) BETWEEN 1 AND 12) AND (z = '' OR o.sign || o.u || o.name || o.name2 || o.code <> '')
), timed AS (
  SELECT ord, epoch(day)::BIGINT + h * 3600 + mn * 60 + sc AS wall, CASE WHEN f = '' THEN 0 ELSE rpad(left(f, 6), 6, '0')::BIGINT END AS micros, o, z,
    CASE WHEN o.sign <> '' THEN CASE WHEN coalesce(try_cast(o.om AS INT), 0) < 60 THEN CASE WHEN o.sign = '+' THEN 1 ELSE -1 END * (try_cast(o.oh AS INT) * 60 + coalesce(try_cast(o.om AS INT), 0)) END WHEN o.u IN ('Z', 'z') THEN 0 WHEN o.code <> '' OR o.u <> '' THEN (SELECT any_value(offset_minutes) FROM zone_codes WHERE upper(zone_code) = upper(o.code || o.u)) END AS minutes,
    CASE WHEN z = '' THEN time_zone WHEN o.name || o.name2 <> '' THEN o.name || o.name2 END AS zone
  FROM walls WHERE h < 24 AND mn < 60 AND sc < 60
), zoned AS (
  SELECT ord, wall, micros, epoch(timezone(zone, make_timestamp(wall * 1000000)))::BIGINT AS u, zone FROM timed WHERE zone IS NOT NULL AND zone <> '' AND zone IN (SELECT name FROM pg_timezone_names())
), back AS (SELECT *, list_filter([0, -1800, 1800, -3600, 3600, -7200, 7200, -10800, 10800], lambda k: epoch(timezone(zone, to_timestamp(u + k)))::BIGINT = wall) AS hits FROM zoned)
SELECT ord, utc_micros FROM (
  SELECT ord, (wall - minutes * 60) * 1000000 + micros AS utc_micros FROM timed WHERE minutes BETWEEN -720 AND 840
  UNION SELECT ord, (u + hits[1]) * 1000000 + micros FROM back WHERE len(hits) = 1
  UNION SELECT ord, ((n || rpad(left(nf, 6), 6, '0'))::HUGEINT // pow(10, p)::HUGEINT)::BIGINT FROM (SELECT ord, n, nf, unnest([0, 3, 6, 9]) AS p FROM parts WHERE n <> '' AND length(n) <= 21) WHERE n::HUGEINT // pow(10, p)::HUGEINT >= 1420070400 AND n::HUGEINT // pow(10, p)::HUGEINT < 1893456000)
"""
# The same for every row, with the reason where there is no instant.
_JUDGED = (
    _INSTANTS[: _INSTANTS.index("), walls AS (")]
    .replace("  FROM c WHERE s <> ''\n", "  FROM c\n")
    .replace("SELECT ord, time_zone, lower(trim(date_order)) AS date_order,", "SELECT ord, raw, time_zone, lower(trim(date_order)) AS date_order,")
    .replace("SELECT ord, time_zone, e.n AS n", "SELECT ord, raw, s, time_zone, e.n AS n")
    .replace("SELECT ord, time_zone, n, nf, k,", "SELECT ord, raw, s, time_zone, n, nf, k, k = 'a' AND a.p <> '' AND coalesce(date_order, '') NOT IN ('dmy', 'mdy') AND try_cast(a.p AS INT) <> try_cast(a.q AS INT) AS unordered,")
    .replace(" FROM fields WHERE k <> '' AND NOT bad", " FROM fields")
) + r"""), timed AS (
  SELECT *, CASE WHEN ap = '' THEN coalesce(try_cast(hh AS INT), 0) ELSE try_cast(hh AS INT) % 12 + CASE WHEN ap = 'pm' THEN 12 ELSE 0 END END AS h, coalesce(try_cast(mi AS INT), 0) AS mn, coalesce(try_cast(ss AS INT), 0) AS sc,
    CASE WHEN f = '' THEN 0 ELSE rpad(left(f, 6), 6, '0')::BIGINT END AS micros, CASE WHEN o.sign = '+' THEN 1 ELSE -1 END * (coalesce(try_cast(o.oh AS INT), 0) * 60 + coalesce(try_cast(o.om AS INT), 0)) AS away,
    (SELECT any_value(offset_minutes) FROM zone_codes WHERE upper(zone_code) = upper(o.code)) AS coded, CASE WHEN z = '' THEN time_zone ELSE o.name || o.name2 END AS zone FROM days
), judged AS (
  SELECT *, epoch(day)::BIGINT + h * 3600 + mn * 60 + sc AS wall, CASE WHEN s = '' THEN 'absent' WHEN n <> '' THEN 'number' WHEN k = '' OR bad OR (z <> '' AND o.sign || o.u || o.name || o.name2 || o.code = '') THEN 'unknown shape' WHEN unordered THEN 'order of day and month not known'
    WHEN day IS NULL THEN 'impossible date' WHEN w <> '' AND w NOT IN (lower(dayname(day)), lower(dayname(day))[:3]) THEN 'contradicting day of the week' WHEN ap <> '' AND try_cast(hh AS INT) NOT BETWEEN 1 AND 12 OR h > 23 OR mn > 59 OR sc > 59 THEN 'impossible time'
    WHEN o.sign <> '' THEN CASE WHEN coalesce(try_cast(o.om AS INT), 0) > 59 OR away NOT BETWEEN -720 AND 840 THEN 'impossible offset' ELSE 'offset' END WHEN o.u <> '' THEN CASE WHEN upper(o.u) = 'Z' THEN 'offset' ELSE 'unknown zone' END
    WHEN o.code <> '' THEN CASE WHEN coded IS NULL THEN 'unknown zone' ELSE 'coded' END WHEN coalesce(zone, '') = '' THEN 'no zone' WHEN zone NOT IN (SELECT name FROM pg_timezone_names()) THEN 'unknown zone' ELSE 'zone' END AS how FROM timed
), zoned AS (
  SELECT ord, wall, epoch(timezone(zone, make_timestamp(wall * 1000000)))::BIGINT AS u, zone FROM judged WHERE how = 'zone'
), back AS (SELECT ord, u, list_filter([0, -1800, 1800, -3600, 3600, -7200, 7200, -10800, 10800], lambda k: epoch(timezone(zone, to_timestamp(u + k)))::BIGINT = wall) AS hits FROM zoned),
plain AS (SELECT ord, any_value(((n || rpad(left(nf, 6), 6, '0'))::HUGEINT // pow(10, p)::HUGEINT)::BIGINT) AS v FROM (SELECT ord, n, nf, unnest([0, 3, 6, 9]) AS p FROM parts WHERE n <> '' AND length(n) <= 21) WHERE n::HUGEINT // pow(10, p)::HUGEINT >= 1420070400 AND n::HUGEINT // pow(10, p)::HUGEINT < 1893456000 GROUP BY ord)
SELECT ord, raw AS concept_ts, CASE how WHEN 'number' THEN v WHEN 'offset' THEN (wall - CASE WHEN o.sign <> '' THEN away ELSE 0 END * 60) * 1000000 + micros WHEN 'coded' THEN (wall - coded * 60) * 1000000 + micros WHEN 'zone' THEN CASE WHEN len(hits) = 1 THEN (u + hits[1]) * 1000000 + micros END END AS utc_micros,
  CASE how WHEN 'number' THEN CASE WHEN v IS NULL THEN 'impossible number' ELSE 'ok' END WHEN 'zone' THEN CASE len(hits) WHEN 0 THEN 'skipped wall time' WHEN 1 THEN 'ok' ELSE 'repeated wall time' END WHEN 'offset' THEN 'ok' WHEN 'coded' THEN 'ok' ELSE how END AS status
FROM judged LEFT JOIN back USING (ord) LEFT JOIN plain USING (ord)
"""
SQL = {
    "p4_found": _INSTANTS,
    "p4_instants": _JUDGED,
    "p5_found": _ORPHANS + "SELECT DISTINCT relation_id FROM orphan",
    "p5_levels": _ORPHANS + _NAMED_LEVELS + "SELECT CASE WHEN k LIKE 'id:%' THEN 'target_id' ELSE 'target_ref' END AS column_name, level, count(*) AS n FROM found GROUP BY 1, 2",
    "p5_cascade": _ORPHANS + _LEVELS + "SELECT relation_id, level FROM levels",
    "p5_report": _ORPHANS + _LEVELS + _SPANS + """
, every AS (
  SELECT refs.*, level, CASE WHEN orphan.relation_id IS NULL THEN NULL WHEN last IS NULL THEN 'missing' WHEN first > refs.seen_at THEN 'later'
    WHEN last <= refs.seen_at THEN 'deleted' ELSE 'between' END AS reason
  FROM refs LEFT JOIN levels USING (relation_id) LEFT JOIN orphan USING (relation_id) LEFT JOIN spans ON spans.k = refs.k WHERE refs.k IS NOT NULL
)
SELECT 'code_relations' AS table_name, CASE WHEN k LIKE 'id:%' THEN 'target_id' ELSE 'target_ref' END AS column_name, strftime(seen_at, '%Y-%m') AS period,
  count(*) AS n_references, count(*) FILTER (level = 0) AS n_direct, count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'deleted') AS n_deleted,
  count(*) FILTER (reason = 'later') AS n_later, count(*) FILTER (reason = 'between') AS n_between, count(*) FILTER (level > 0) AS n_inherited
FROM every GROUP BY 1, 2, 3""",
}
