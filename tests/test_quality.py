import datetime as dt
import zoneinfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marrow.functions import skew, zones
from marrow.operators import orphans, timestamps

CODES = {"CET": 60, "EST": -300}


def instant(text, zone=None, order=None):
    micros, good, status = timestamps.convert([text], [zone], [order], CODES)
    return int(micros[0]) if good[0] else status[0]


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2024-03-01T07:30:52z", None, None, utc(2024, 3, 1, 7, 30, 52)), (' "2024-03-01T07:30:52+0200" \n', None, None, utc(2024, 3, 1, 5, 30, 52)), ("2024-03-01 07:30:52,9999999 -03:30", None, None, utc(2024, 3, 1, 11, 0, 52) + 999_999),
        ("2024-03-01T07:30+02:00[Europe/Berlin]", None, None, utc(2024, 3, 1, 5, 30)), ("2024-07-01 12:00:00 Europe/Berlin", None, None, utc(2024, 7, 1, 10)), ("2024-07-01 12:00:00 CET", "Asia/Tokyo", None, utc(2024, 7, 1, 11)),
        ("2024-07-01 12:00:00 XYZ", "Asia/Tokyo", None, "unknown zone"), ("2024-07-01", "Asia/Tokyo", None, utc(2024, 6, 30, 15)), ("20240701", "UTC", None, utc(2024, 7, 1)), ("20240701T010203Z", None, None, utc(2024, 7, 1, 1, 2, 3)),
        ("01/02/2024 03:04", "UTC", "dmy", utc(2024, 2, 1, 3, 4)), ("01/02/2024 03:04", "UTC", "mdy", utc(2024, 1, 2, 3, 4)), ("13/12/2024 03:04", "UTC", "mdy", "impossible date"), ("1.2.2024 03:04", "UTC", None, "order of day and month not known"),
        ("Mar 26, 2023 12:21:23 AM", "UTC", None, utc(2023, 3, 26, 0, 21, 23)), ("December 5, 2025 12:57:40 PM", "UTC", None, utc(2025, 12, 5, 12, 57, 40)), ("Mar 26, 2023 13:21:23 PM", "UTC", None, "impossible time"),
        ("Tue, 10 Sep 2019 02:59:32 GMT", None, None, "unknown zone"), ("Wed Dec 10 01:24:27 2025", "UTC", None, utc(2025, 12, 10, 1, 24, 27)), ("Mon Dec 10 01:24:27 2025", "UTC", None, "contradicting day of the week"),
        ("2026年4月12日 14:04", "UTC", None, utc(2026, 4, 12, 14, 4)), ("17 March 2020, 23:58", "UTC", None, utc(2020, 3, 17, 23, 58)), ("1560374011.6", None, None, 1560374011_600000), ("1662294248952847999", None, None, 1662294248_952847),
        ("1662294248952", None, None, 1662294248_952000), ("1234567890", None, None, "impossible number"), ("20250724123045", None, None, "impossible number"), ("9" * 30, None, None, "impossible number"),
        ("2024-02-30", "UTC", None, "impossible date"), ("2023-02-29T00:00:00Z", None, None, "impossible date"), ("2024-01-01T24:00:00Z", None, None, "impossible time"), ("2024-01-01 00:00:60", "UTC", None, "impossible time"),
        ("2024-01-01T00:00:00+25:00", None, None, "impossible offset"), ("2021-W60-1", "UTC", None, "impossible date"), ("2021-W01-1", "UTC", None, utc(2021, 1, 4)), ("June 2021", "UTC", None, "unknown shape"), ("Q3 2022", "UTC", None, "unknown shape"),
        ("2024-03-31 02:30:00", "Europe/Berlin", None, "skipped wall time"), ("2024-10-27 02:30:00", "Europe/Berlin", None, "repeated wall time"), ("2024-10-27 02:30:00", None, None, "no zone"), ("2024-10-27 02:30:00", "No/Where", None, "unknown zone"),
        ("2018-11-04", "America/Sao_Paulo", None, "skipped wall time"), (None, "UTC", None, "absent"), ("  ", "UTC", None, "absent"), ("x" * 10_000, "UTC", None, "unknown shape"), ('""', "UTC", None, "absent"),
    ],
)
def test_instants(text, zone, order, want):
    assert instant(text, zone, order) == want


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2024-03-01T07:30:52." + "9" * 70 + "Z", None, utc(2024, 3, 1, 7, 30, 52) + 999_999), ("2024-03-01 07:30:52,123456" + "0" * 90_000 + " +02:00", None, utc(2024, 3, 1, 5, 30, 52) + 123_456), ("0" * 5_000 + "1560374011.6", None, 1560374011_600000),
        ("0" * 12 + "1662294248952847999", None, 1662294248_952847), ("0" * 30, None, "impossible number"), ("0" * 30 + "1", None, "impossible number"), ("9" * 6_000, None, "impossible number"), ("1560374011." + "5" * 6_000, None, 1560374011_555555),
        ('" ' * 50_000 + "2024-03-01" + "' " * 50_000, "UTC", utc(2024, 3, 1)), ("2024-03-01T07:30:52+02:00 (" + "Central European Time " * 40 + ")", None, utc(2024, 3, 1, 5, 30, 52)),
    ],
)
def test_length_does_not_matter(text, zone, want):
    assert instant(text, zone) == want


def test_forgetting_masks_changes_nothing(monkeypatch):
    texts = ["2024-03-01T07:30:52Z", "a" * 40, "2024-03-01", "b-" * 30, "1560374011", "c " * 20 + "d", "Mar 26, 2023 12:21:23 AM"] * 3
    want = [instant(t, "UTC") for t in texts]
    monkeypatch.setattr(timestamps, "MEMORY", 150)
    timestamps._shapes.clear()
    assert [instant(t, "UTC") for t in texts] == want
    assert sum(map(len, timestamps._shapes)) <= 150


@settings(max_examples=150, deadline=None)
@given(st.datetimes(dt.datetime(1950, 1, 1), dt.datetime(2090, 1, 1)).map(lambda d: d.replace(microsecond=0)), st.sampled_from(["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Lord_Howe", "America/Sao_Paulo", "Africa/Casablanca", "UTC"]))
def test_zone_tables_agree_with_the_library(wall, name):
    z = zoneinfo.ZoneInfo(name)
    options = set()
    for fold in (0, 1):
        u = wall.replace(tzinfo=z, fold=fold).astimezone(dt.UTC)
        if u.astimezone(z).replace(tzinfo=None) == wall:
            options.add(int(u.timestamp()))
    got, n = zones.table(name).to_utc(np.array([int((wall - dt.datetime(1970, 1, 1)).total_seconds())]))
    assert n[0] == len(options) and (len(options) != 1 or got[0] in options)


def test_normalise_keeps_columns(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", 1, {"a": "b"}, "z"), (None, 2, None, "y"), ("2024-01-01T00:00:00Z", 1, {"a": "b"}, "z")], "ts string, utc_micros int, _text map<string,string>, _zone string")
    got = timestamps.normalise(df, "ts", F.lit("UTC"), F.lit(None).cast("string"), {})
    assert got.columns == ["ts", "_text", "_zone", "utc_micros", "status"]
    assert got.schema["utc_micros"].metadata == {"zone_tables": zones.version()}
    assert [r["utc_micros"] for r in got.collect()] == [utc(2024, 1, 1), None, utc(2024, 1, 1)]
    assert timestamps.normalise(df.limit(0), "ts", F.lit("UTC"), F.lit("dmy"), {}).count() == 0


def test_zone_codes(spark):
    t = spark.createDataFrame([("CET", 60), ("IST", 330), ("IST", 120), (None, 1), ("cet", 60)], "zone_code string, offset_minutes int")
    assert timestamps.zone_code_table(t) == {"CET": 60}


ENTITY = "entity_id string, external_id string, indexed_at timestamp_ntz, deleted_at timestamp_ntz, extra string"
RELATION = "relation_id long, source_entity_id string, target_id string, target_ref string, seen_at timestamp_ntz, key string"
D = lambda n: dt.datetime(2024, 1, n)


@pytest.fixture
def graph(spark):
    entities = spark.createDataFrame([("a", "x1", D(1), D(5), ""), ("a", None, D(7), None, ""), ("a", None, D(7), None, ""), ("b", " ", D(3), None, ""), ("c", None, D(1), None, "")], ENTITY)
    library = spark.createDataFrame([("lib", "pkg")], "entity_id string, external_id string")
    relations = spark.createDataFrame(
        [
            (1, "c", " a\t", "", D(4), ""), (2, "c", "a", "", D(5), ""), (3, "c", "a", "", D(7), ""), (4, "c", "b", "", D(2), ""), (5, "b", "lost", "pkg", D(2), ""), (6, "b", "  ", "x1", D(6), ""), (7, "b", None, "x1", D(1), ""),
            (8, "b", "", None, D(1), ""), (9, "b", "lib", "", None, ""), (2, "c", "a", "", D(5), ""), (10, "d", "c", "", D(6), ""), (11, "e", "d", "", D(6), ""), (12, "c", "c", "", D(6), ""), (13, "z", "lib", "", D(6), ""),
        ],
        RELATION,
    )
    return relations, entities, library


def test_orphans(graph):
    relations, entities, library = graph
    found = orphans.direct_orphans(relations, entities, library)
    assert sorted(r["relation_id"] for r in found.collect()) == [2, 4, 5, 6, 11]
    reasons = {r["relation_id"]: r["reason"] for r in orphans.reasons(found, entities, library).collect()}
    assert reasons == {2: "between", 4: "later", 5: "missing", 6: "deleted", 11: "missing"}
    levels = {r["relation_id"]: r["level"] for r in orphans.cascade(orphans.references(relations), found).collect()}
    assert levels == {2: 0, 4: 0, 5: 0, 6: 0, 11: 0, 10: 1, 12: 1}
    rows = orphans.report(relations, entities, library).collect()
    assert sum(r["n_references"] for r in rows) == 12 and sum(r["n_direct"] for r in rows) == 5 and sum(r["n_inherited"] for r in rows) == 2
    assert orphans.direct_orphans(relations.limit(0), entities, library).count() == 0
    assert orphans.direct_orphans(relations, entities.limit(0), library.limit(0)).count() == 12
    assert orphans.cascade(orphans.references(relations.limit(0)), found.limit(0)).count() == 0


def test_faults_are_inherited_by_external_ids(spark):
    entities = spark.createDataFrame([("a", " xa ", D(1), None, ""), ("b", None, D(1), D(2), ""), ("b", "xb", D(3), None, ""), ("b2", "xb", D(1), None, ""), ("c", "", D(1), None, ""), ("d", "xd", D(1), None, "")], ENTITY)
    library = spark.createDataFrame([("lib", "pkg")], "entity_id string, external_id string")
    relations = spark.createDataFrame(
        [
            (1, "a", "lost", None, D(9), ""), (2, " b", "", "xa", D(9), ""), (3, "c", None, "xb\t", D(9), ""), (4, "e", "c", "pkg", D(9), ""), (5, "d", "", "pkg", D(9), ""), (6, "e", "", "xd", D(9), ""),
            (7, "f", "a", "xd", D(9), ""), (8, "a", None, "xb", D(9), ""), (9, "lib", "e", None, D(9), ""), (10, "g", "b2", None, D(9), ""),
        ],
        RELATION,
    )
    found = orphans.direct_orphans(relations, entities, library)
    levels = {r["relation_id"]: r["level"] for r in orphans.cascade(orphans.references(relations), found, names=orphans.aliases(entities, library)).collect()}
    # 9 is an orphan itself, as e is nowhere, so lib is faulty at once, and what names it by pkg (5) and then d by xd (6) follow
    assert levels == {1: 0, 9: 0, 2: 1, 7: 1, 3: 2, 8: 2, 4: 3, 5: 1, 6: 2}
    rows = orphans.report(relations, entities, library).collect()
    assert {c: sum(r["n_inherited"] for r in rows if r["column_name"] == c) for c in ("target_id", "target_ref")} == {"target_id": 2, "target_ref": 5}
    assert sum(r["n_direct"] for r in rows) == 2
    assert orphans.cascade(orphans.references(relations), found, names=orphans.aliases(entities.limit(0), library.limit(0))).count() == 3  # by ids only


def test_salted_join_is_a_join(spark):
    many = spark.range(3000).select(F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"), "id")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "key string, v int")
    assert "hot" in skew.hot_keys(many, "key")
    for how in ("left_anti", "left_semi", "inner", "left"):
        want = many.join(few, "key", how)
        got = skew.salted_join(many, few, "key", how, spread="id")
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr), how


def brute_levels(relations, entities):
    """Levels by plain search: lives of targets, then faults passed on from record to record by all their keys."""
    lives, keys = {}, {}
    for e, x, begins, ends, _ in entities:
        for k in ([("id", e)] if e else []) + ([("ext", x)] if x else []):
            lives.setdefault(k, []).append((begins, ends))
            keys.setdefault(e, set()).add(k)
    refs = {(r, s, ("id", t) if t else ("ext", x), at) for r, s, t, x, at, _ in relations if t or x}
    level = {r: 0 for r, _, k, at in refs if not any(a <= at and (b is None or at < b) for a, b in lives.get(k, []))}
    reached, frontier, n = set(), {s for r, s, *_ in refs if level.get(r) == 0}, 0
    while frontier:
        reached |= frontier
        faulty = set().union(*({("id", s)} | keys.get(s, set()) for s in frontier))
        n += 1
        found = {(r, s) for r, s, k, _ in refs if k in faulty and r not in level}
        level |= {r: n for r, _ in found}
        frontier = {s for r, s, k, _ in refs if k in faulty} - reached
    return level


def test_levels_of_a_random_graph_with_a_hot_target(spark):
    import random

    rnd = random.Random(11)
    names = [f"e{k}" for k in range(120)]
    entities = [(e, f"x{k % 90}" if k % 3 else None, D(rnd.randint(1, 5)), D(rnd.randint(20, 28)) if k % 17 == 0 else None, "") for k, e in enumerate(names)]
    relations = []
    for r in range(1500):
        target = "e7" if r % 3 == 0 else rnd.choice([*names, "lost"]) if r % 29 == 0 else rnd.choice(names)
        by_ref = r % 5 == 1
        relations.append((r, f"s{r}" if r % 3 == 0 else rnd.choice(names) if r % 4 == 0 else f"leaf{r}", "" if by_ref else target, rnd.choice([f"x{rnd.randint(0, 89)}"]) if by_ref else None, D(rnd.randint(6, 19)) if r % 50 else D(3), ""))
    want = brute_levels(relations, entities)
    assert len(set(want.values())) > 3
    tables = spark.createDataFrame(relations + relations[:100], RELATION), spark.createDataFrame(entities, ENTITY), spark.createDataFrame([], "entity_id string, external_id string")
    assert "id:e7" in skew.hot_keys(orphans.references(tables[0]), "key")
    assert {r["relation_id"]: r["level"] for r in orphans.levels(*tables).collect()} == want
    rows = orphans.level_counts(*tables).collect()
    assert {(r["level"]) for r in rows} == set(want.values()) and sum(r["n"] for r in rows) == len(want)
    empty = tuple(t.limit(0) for t in tables)
    assert orphans.levels(*empty).count() == 0 and orphans.report(*empty).count() == 0
