"""Mixed timestamp formats and zones, normalised to one UTC instant or to none.

Each text is reduced to a shape mask (a digit is 9, an ASCII letter A, everything else itself). A mask is looked up
once: a grammar over masks tells which kind of timestamp it is and at which offsets its fields stand. All texts of a
mask are then read at once, as columns of a matrix of characters, and converted with whole-array arithmetic through
zone transition tables.

Defined cases: NULL and blank texts, texts of an unknown shape, impossible or incomplete dates and times, unknown
zone names and abbreviations, contradicting days of the week, wall times that the zone skips or repeats, and texts
without zone whose default zone is NULL or unknown have no instant, each with its reason in ``status``; texts are read
whole, however long; digits beyond microseconds are cut off and leading zeros of plain numbers left out before the mask is
made; a date in digits whose order is not known has no instant unless the order makes no difference; repeated rows
give the same result; extra columns are kept. The metadata of ``utc_micros`` name the version of the zone tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.functions import zones

_MASK = {c: ord("9") for c in range(ord("0"), ord("9") + 1)} | {c: ord("A") for c in range(128) if chr(c).isalpha()}
_MONTHS = {m: k for k, m in enumerate(("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"), 1)}
_MONTHS |= {m[:3]: k for m, k in _MONTHS.items()} | {"sept": 9}
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_DAYS_OF = {d: k for k, d in enumerate(_DAYS)} | {d[:3]: k for k, d in enumerate(_DAYS)} | {"tues": 1, "thur": 3, "thurs": 3}
#: Characters of masks that a worker remembers; beyond, the memory is emptied, which changes no result.
MEMORY = 4_000_000
#: Numbers of seconds that count as plain: those of 2015 to 2030.
EPOCH_FROM, EPOCH_TO = 1_420_070_400, 1_893_456_000
#: Offsets in use on earth, in minutes.
OFFSET_LEAST, OFFSET_MOST = -12 * 60, 14 * 60

_TIME = r"(?P<H>9{1,2}):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>AA)(?![A/]))?"
_OFFSET = r"(?P<o>[+\-−]99(?::?99)?)"
_NAMED = r"(?P<z>A[A_]*(?:/[A_+\-9]+)+)"
_CODE = r"(?P<c>A{1,5})"
_ZONE = rf"(?: ?{_OFFSET}(?: ?(?:\[(?P<ignored>[^\]]*)\]|\((?P<ignored2>[^)]*)\)))?| ?(?P<u>A)(?: ?\[(?P<ignored3>[^\]]*)\])?| {_NAMED}| ?\[(?P<z2>[A_/+\-9]+)\]| {_CODE})?"
_DATES = {
    "ymd": r"(?P<Y>9999)(?P<s>[-/.])(?P<m>9{1,2})(?P=s)(?P<d>9{1,2})",
    "xxy": r"(?P<p>9{1,2})(?P<s>[-/.])(?P<q>9{1,2})(?P=s)(?P<Y>9999)",
    "zh": r"(?P<Y>9999) ?年 ?(?P<m>9{1,2}) ?月 ?(?P<d>9{1,2}) ?日",
    "dmon": r"(?:(?P<w>A{3,9}),? )?(?P<d>9{1,2})(?:AA)?[ -](?P<mon>A{3,9}),?[ -](?P<Y>9999)",
    "mond": r"(?:(?P<w>A{3,9}),? )?(?P<mon>A{3,9}) +(?P<d>9{1,2}),? (?P<Y>9999)",
    "week": r"(?P<Y>9999)-(?P<W>A99)-(?P<k>9)",
}
_GRAMMAR = [
    re.compile(r"(?P<n>9{10,})(?:\.(?P<f>9+))?"),
    re.compile(rf"(?P<Y>9999)(?P<m>99)(?P<d>99)(?:(?P<T>A| )(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?{_ZONE})?"),
    re.compile(rf"(?P<w>A{{3,9}}),? (?P<mon>A{{3,9}}) +(?P<d>9{{1,2}}) {_TIME} (?P<Y>9999){_ZONE}"),
    re.compile(rf"(?P<w>A{{3,9}}),? (?P<mon>A{{3,9}}) +(?P<d>9{{1,2}}) {_TIME}(?: {_OFFSET}| {_CODE}) (?P<Y>9999)"),
    *(re.compile(rf"{date}(?:(?P<T>A)|,? ){_TIME}{_ZONE}") for date in _DATES.values()),
    *(re.compile(date) for date in _DATES.values()),
]


@dataclass(frozen=True)
class Shape:
    """Where the fields of a mask stand."""

    fields: dict[str, tuple[int, int]]


_shapes: dict[str, Shape | None] = {}
_remembered = [0]


def shape_of(mask: str) -> Shape | None:
    if mask in _shapes:
        return _shapes[mask]
    m = next((m for g in _GRAMMAR if (m := g.fullmatch(mask))), None)
    shape = Shape({k: m.span(k) for k, v in m.groupdict().items() if v is not None}) if m else None
    _remembered[0] += len(mask) + 64
    if _remembered[0] > MEMORY:
        _shapes.clear()
        _remembered[0] = len(mask) + 64
    _shapes[mask] = shape
    return shape


_AROUND = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\"'`“”‘’«»\ufeff\u200b"
_BLANK = re.compile(r"[^\S ]")
_BEYOND_MICROS = re.compile(r"(?<=[0-9])([.,][0-9]{6})[0-9]+")
_PADDING = re.compile(r"0+(?=[0-9]{10,}(?:\.[0-9]+)?\Z)")


def trimmed(text: str) -> str:
    """The text without whitespace and quotes around it, digits beyond microseconds and zeros before plain numbers."""
    t = _BLANK.sub(" ", text.strip(_AROUND))
    if t.startswith("0"):
        m = _PADDING.match(t)
        t = t[m.end() :] if m else t
    return _BEYOND_MICROS.sub(r"\1", t)


def _digits(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    n = np.zeros(len(chars), np.int64)
    for k in range(*span):
        n = n * 10 + (chars[:, k].astype(np.int64) - 48)
    return n


def _days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


_MONTH_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _real(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return ok & (d <= _MONTH_DAYS[np.where(ok, m, 0)] + ((m == 2) & leap))


def _words(texts: list[str], span: tuple[int, int], table: dict[str, int]) -> np.ndarray:
    a, b = span
    return np.array([table.get(t[a:b].lower(), -1) for t in texts], np.int64)


def convert(texts: list[str | None], default_zones: list[str | None], orders: list[str | None], codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Microseconds since 1970 UTC, whether there is an instant, and the reason or ``ok``, of each text."""
    n = len(texts)
    micros, good, status = np.zeros(n, np.int64), np.zeros(n, bool), ["absent"] * n
    groups: dict[str, list[int]] = {}
    clean: list[str] = [""] * n
    for i, t in enumerate(texts):
        if t:
            c = trimmed(t)
            if c:
                clean[i] = c
                groups.setdefault(c.translate(_MASK), []).append(i)
    for mask, rows in groups.items():
        shape = shape_of(mask)
        if shape is None:
            for i in rows:
                status[i] = "unknown shape"
            continue
        at = np.array(rows)
        value, ok, why = _of_shape(shape, [clean[i] for i in rows], [default_zones[i] for i in rows], [orders[i] for i in rows], codes)
        micros[at], good[at] = value, ok
        for i, w in zip(rows, why, strict=True):
            status[i] = w
    return micros, good, status


def _fraction(chars: np.ndarray, span: tuple[int, int] | None) -> np.ndarray:
    if span is None:
        return np.zeros(len(chars), np.int64)
    a, b = span
    used = min(b - a, 6)
    return _digits(chars, (a, a + used)) * 10 ** (6 - used)


def _of_shape(shape: Shape, texts: list[str], default_zones: list, orders: list, codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    f = shape.fields
    n = len(texts)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(n, -1)
    if "n" in f:
        return _epoch(f, texts, chars)
    why = np.full(n, "ok", object)
    bad = np.zeros(n, bool)

    def fail(where: np.ndarray, reason: str) -> None:
        why[where & ~bad] = reason
        np.logical_or(bad, where, out=bad)

    year = _digits(chars, f["Y"])
    if "W" in f:
        a, b = f["W"]
        week, weekday = _digits(chars, (a + 1, b)), _digits(chars, f["k"])
        jan4 = _days_from_civil(year, np.ones(n, np.int64), np.full(n, 4))
        monday = jan4 - (jan4 + 3) % 7
        next4 = _days_from_civil(year + 1, np.ones(n, np.int64), np.full(n, 4))
        weeks = (next4 - (next4 + 3) % 7 - monday) // 7
        is_w = np.isin(chars[:, a], (ord("W"), ord("w")))
        fail(~is_w | (week < 1) | (week > weeks) | (weekday < 1) | (weekday > 7), "impossible date")
        days = monday + (week - 1) * 7 + weekday - 1
    else:
        if "mon" in f:
            month, day = _words(texts, f["mon"], _MONTHS), _digits(chars, f["d"])
        elif "p" in f:
            p, q = _digits(chars, f["p"]), _digits(chars, f["q"])
            dmy = np.array([o == "dmy" for o in orders])
            known = dmy | np.array([o == "mdy" for o in orders])
            fail(~known & (p != q), "order of day and month not known")
            day, month = np.where(dmy, p, q), np.where(dmy, q, p)
        else:
            month, day = _digits(chars, f["m"]), _digits(chars, f["d"])
        fail(~_real(year, month, day), "impossible date")
        month, day = np.where(bad, 1, month), np.where(bad, 1, day)
        days = _days_from_civil(year, month, day)
    if "w" in f:
        weekday = _words(texts, f["w"], _DAYS_OF)
        fail((weekday < 0) | (weekday != (days + 3) % 7), "contradicting day of the week")
    if "T" in f:
        fail(~np.isin(chars[:, f["T"][0]], (ord("T"), ord("t"), 32)), "unknown shape")
    hour = _digits(chars, f["H"]) if "H" in f else np.zeros(n, np.int64)
    minute = _digits(chars, f["M"]) if "M" in f else np.zeros(n, np.int64)
    second = _digits(chars, f["S"]) if "S" in f else np.zeros(n, np.int64)
    if "ap" in f:
        half = np.array([{"am": 0, "pm": 1}.get(t[f["ap"][0] : f["ap"][1]].lower(), -1) for t in texts])
        fail(half < 0, "unknown shape")
        fail((hour < 1) | (hour > 12), "impossible time")
        hour = hour % 12 + 12 * (half == 1)
    fail((hour > 23) | (minute > 59) | (second > 59), "impossible time")
    wall = days * 86400 + hour * 3600 + minute * 60 + second
    utc = np.zeros(n, np.int64)
    if "o" in f:
        a, b = f["o"]
        minutes = _digits(chars, (a + 1, a + 3)) * 60
        rest = np.zeros(n, np.int64) if b - a == 3 else _digits(chars, (b - 2, b))
        fail(rest > 59, "impossible offset")
        offset = np.where(chars[:, a] == ord("+"), 1, -1) * (minutes + rest)
        fail((offset < OFFSET_LEAST) | (offset > OFFSET_MOST), "impossible offset")
        utc = wall - offset * 60
    elif "u" in f:
        a = f["u"][0]
        fail(~np.isin(chars[:, a], (ord("Z"), ord("z"))), "unknown zone")
        utc = wall
    elif "c" in f:
        a, b = f["c"]
        offset = np.array([codes.get(t[a:b].upper(), 10_000) for t in texts], np.int64)
        fail(offset == 10_000, "unknown zone")
        utc = wall - offset * 60
    else:
        span = f.get("z") or f.get("z2")
        names = [t[span[0] : span[1]] for t in texts] if span else default_zones
        by_zone: dict[str | None, list[int]] = {}
        for i, name in enumerate(names):
            by_zone.setdefault(name or None, []).append(i)
        for name, rows in by_zone.items():
            at, here = np.array(rows), np.zeros(n, bool)
            here[at] = True
            zone = zones.table(name.strip()) if name else None
            if zone is None:
                fail(here, "no zone" if name is None else "unknown zone")
                continue
            utc[at], count = zone.to_utc(wall[at])
            here[at] = count == 0
            fail(here, "skipped wall time")
            here[at] = count > 1
            fail(here, "repeated wall time")
    return utc * 1_000_000 + _fraction(chars, f.get("f")), ~bad, why.tolist()


def _epoch(f: dict, texts: list[str], chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Plain numbers: the unit is the one that puts them between 2015 and 2030."""
    out, ok = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    a, b = f["n"]
    if b - a > 21:  # without leading zeros: beyond 2030 in any unit
        return out, ok, ["impossible number"] * len(texts)
    for i, t in enumerate(texts):
        whole, frac = int(t[a:b]), (t[f["f"][0] : f["f"][1]] if "f" in f else "")
        for digits in (0, 3, 6, 9):
            if EPOCH_FROM <= whole // 10**digits < EPOCH_TO:
                # microseconds of whole.frac in units of 10**-digits seconds, cut off
                scaled = int(str(whole) + (frac + "0" * 6)[:6])
                out[i], ok[i] = scaled // 10**digits, True
    return out, ok, ["ok" if k else "impossible number" for k in ok]


#: Most abbreviations that are taken to the executors with the code.
MOST_CODES = 10_000


def zone_code_table(zone_codes: DataFrame) -> dict[str, int]:
    """Minutes east of UTC by abbreviation, from a table of a proven bound."""
    rows = zone_codes.where("zone_code is not null and offset_minutes is not null").select(F.upper("zone_code").alias("c"), F.col("offset_minutes").cast("int").alias("m")).distinct().limit(MOST_CODES + 1).collect()
    if len(rows) > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} zone abbreviations")
    seen: dict[str, set[int]] = {}
    for r in rows:
        seen.setdefault(r["c"], set()).add(r["m"])
    return {c: m.pop() for c, m in seen.items() if len(m) == 1}  # an abbreviation with two offsets names none


def normalise(df: DataFrame, text: str, zone: Column, order: Column, codes: dict[str, int]) -> DataFrame:
    """``df`` with ``utc_micros`` (NULL if undetermined) and ``status``; one Arrow pass, no shuffle."""

    kept = df.drop("utc_micros", "status") if {"utc_micros", "status"} & set(df.columns) else df
    n = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            micros, good, status = convert(*(batch.column(n + k).to_pylist() for k in range(3)), codes)
            cols = [*(batch.column(k) for k in range(n)), pa.array(micros, mask=~good), pa.array(status, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:n], "utc_micros", "status"])

    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema), "utc_micros long", "status string"])
    free = "_" + max(("", *(c for c in kept.columns)), key=len)  # longer than any name there is
    return kept.select("*", F.col(text).alias(f"{free}_t"), zone.alias(f"{free}_z"), order.alias(f"{free}_o")).mapInArrow(run, schema).withMetadata("utc_micros", {"zone_tables": zones.version()})


def normalise_concepts(concepts: DataFrame, repositories: DataFrame, zone_codes: DataFrame) -> DataFrame:
    """(ord, concept_ts, utc_micros, status) of every row of ``concepts``; the repository gives zone and order of dates."""
    repos = repositories.where(F.trim("repository_id") != "").groupBy("repository_id").agg(F.max("time_zone").alias("time_zone"), F.max("date_order").alias("date_order"))
    rows = concepts.select("ord", "concept_ts", "repository_id").join(repos, "repository_id", "left")
    found = normalise(rows, "concept_ts", F.col("time_zone"), F.lower(F.trim("date_order")), zone_code_table(zone_codes))
    return found.select("ord", "concept_ts", "utc_micros", "status")
