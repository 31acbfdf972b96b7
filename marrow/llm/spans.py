"""Long exact spans that stand verbatim in more than one record, and how much of each record they cover.

Anchors are blocks of ``block`` characters, half the least span, taken from the rolling hashes of every window of
that length. A span of ``least`` characters holds ``least - block + 1`` such windows; the one with the smallest hash
(the leftmost of equals) is its anchor, so equal spans have equal anchors wherever they stand, and one window in
about ``(least - block + 2) / 2`` becomes an anchor. An anchor that only one record has cannot lie in a shared span;
it ends there. Hits are extended without ever pairing records: the neighbourhood of an anchor (all spans of ``least``
characters around it) is compared as one key, made where the anchor was found, and where it is not shared as a whole each span of ``least`` characters
is compared by its own key, so a block that a third of all records hold costs as much as one in two of them. Runs of
shared spans are then joined to maximal ones.

Blocks at fixed offsets, probed by every window, would need every window of every text to be shuffled to the index
(8 bytes or more for a character of text); choosing the block by its hash keeps the anchors of both sides equal and
sends one window in about 51. See README for the figures.

Keys of anchors have 64 bits (a collision there only costs work). Keys that decide have 128: a polynomial one, and a
multilinear one with random coefficients, by which any two different spans agree with a probability of at most 2**-64
(its two halves are strongly universal), whatever the texts. In a text that repeats with a period of p characters, p
below ``block``, one window in p is an anchor, all of them with one hash: every window of a run of one character.

Defined cases: NULL, empty and texts shorter than ``least`` have no spans and a share of 0; copies of a whole text are
one span over all of it; a span that is repeated only within its own record is not shared; repeated ids count as one
record; characters are code points, compared exactly; any length of text is handled whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions.session import written

LEAST = 200
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOW, _HALF = _U((1 << 24) - 1), _U(32)
_PIECE = 1 << 23  # characters of a text that are hashed at once; pieces overlap


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads bits, keeps values distinct."""
    x = x + _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SMALL = 1 << 16  # characters of the basic plane are looked up
_spread: list[np.ndarray] = []


def _spread_chars(chars: np.ndarray) -> np.ndarray:
    """``_mix`` of code points."""
    if len(chars) and int(chars.max()) >= _SMALL:
        return _mix(chars.astype(np.uint64))
    if not _spread:
        _spread.append(_mix(np.arange(_SMALL, dtype=np.uint64)))
    return _spread[0][chars]


class Rolling:
    """Hashes of all windows of a text by prefix sums of a polynomial modulo 2**64."""

    _powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, chars: np.ndarray):
        n = len(chars)
        if not self._powers or len(self._powers[0][0]) <= n:
            size = max(1 << 14, 1 << (n + 1).bit_length())
            p, inv = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            p[0] = inv[0] = 1
            self._powers[:] = [(np.cumprod(p, dtype=np.uint64), np.cumprod(inv, dtype=np.uint64))]
        have = self._powers[0]
        self.inverse = have[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_spread_chars(chars) * have[0][:n], out=self.sums[1:])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


_coefficients: dict[int, np.ndarray] = {}
_ROWS = 4096  # windows that are multiplied at once


def strong(chars: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Multilinear hashes of the windows at ``start``: two of 32 bits, the high halves of sums of products modulo 2**64."""
    if length not in _coefficients:
        _coefficients[length] = np.random.default_rng(length).integers(0, 1 << 64, (length + 1, 2), np.uint64)
    c = _coefficients[length]
    windows = np.lib.stride_tricks.sliding_window_view(chars, length)
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(start), _ROWS):
        h = windows[start[a : a + _ROWS]].astype(np.uint64) @ c[1:] + c[0]
        out[a : a + _ROWS] = (h[:, 0] >> _HALF) | ((h[:, 1] >> _HALF) << _HALF)
    return out


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, from running minima of blocks of ``w`` in both directions."""
    n = len(a)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = a
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(chars: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: their hashes, their offsets, and of each how many spans of ``least`` it stands for.

    Anchors come in order; spans of ``least`` characters, counted by their starts, belong to them in the same order.
    """
    block = least // 2
    if len(chars) < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, offsets = [], []
    for begin in range(0, len(chars) - least + 1, _PIECE):
        piece = chars[begin : begin + _PIECE + least - 1]
        h = Rolling(piece).all(block)
        packed = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        chosen = (_sliding_min(packed, least - block + 1) & _LOW).astype(np.int64)
        offsets.append(chosen + begin)
        hashes.append(h[chosen])
    at, h = np.concatenate(offsets), np.concatenate(hashes)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[first], at[first], np.diff(np.r_[first, len(at)])


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _of_texts(docs: DataFrame, schema: str, make, *cols: str) -> DataFrame:
    """Rows that ``make(text, *other columns)`` gives for each document, as columns beside its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, size = [], [], 0
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                got = make(text, *(batch.column(2 + c)[k] for c in range(len(cols))))
                if got is not None and len(got[0]):
                    keys.append(np.full(len(got[0]), batch.column(0)[k].as_py(), np.int64))
                    parts.append(got)
                    size += len(got[0])
                if size > 500_000:
                    yield flush(keys, parts)
                    keys, parts, size = [], [], 0
            if size:
                yield flush(keys, parts)

    names = [x.split()[0] for x in schema.split(",")]

    def flush(keys: list, parts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(np.concatenate(c)) for c in zip(*parts, strict=True))], names=names)

    return docs.select("doc", "text", *cols).mapInArrow(run, schema)


def text_classes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, rep): documents of whose whole text there are copies, and the smallest id among them."""
    keyed = docs.where(F.char_length("text") >= least).select("doc", F.unhex(F.md5(F.encode("text", "utf-8"))).alias("k1"), F.xxhash64("text").alias("k2"))
    classes = keyed.groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.max("doc").alias("most")).where("rep <> most").drop("most")
    return keyed.join(classes, ["k1", "k2"]).select("doc", "rep").distinct()


def shared_spans(documents: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal spans (doc_id, span_start, span_length) of ``least`` or more characters that also stand in another record."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("doc").isNotNull())
    block, reach = least // 2, least - least // 2
    copies = written(text_classes(docs, least), "copies")
    single = docs.where(F.char_length("text") >= least).join(copies.where("doc <> rep").select("doc"), "doc", "left_anti")

    def seeds(text: str):
        chars = code_points(text)
        h, at, _ = anchors(chars, least)
        whole = (at >= reach) & (at + least <= len(chars))  # the neighbourhood lies within the text
        k1, k2 = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if whole.any():
            start = at[whole] - reach
            k1[whole], k2[whole] = Rolling(chars).at(start, reach + least).view(np.int64), strong(chars, start, reach + least).view(np.int64)
        return h.view(np.int64), at.astype(np.int32), k1, k2, whole

    # 1: anchors that more than one record has, with the keys of their neighbourhoods
    found = written(_of_texts(single, "doc long, h long, at int, k1 long, k2 long, whole boolean", seeds), "anchors")
    common = found.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("h")
    hits = written(found.join(written(common, "common"), "h", "left_semi"), "hits")

    def per_text(rows: DataFrame) -> DataFrame:
        # no document has more offsets than characters
        return single.join(rows.groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias("places")), "doc")

    def in_several(rows: DataFrame) -> DataFrame:
        keys = rows.groupBy("k1", "k2").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("k1", "k2")
        return rows.join(keys, ["k1", "k2"], "left_semi").select("doc", "at")

    # 2: those of them that are shared as a whole
    around = written(in_several(hits.where("whole").select("doc", "k1", "k2", "at")), "around")

    # 3: one by one the spans of each anchor that is not shared so in every place where it stands
    def spans(text: str, where: pa.Scalar):
        chars = code_points(text)
        _, at, n = anchors(chars, least)
        start = np.flatnonzero(np.repeat(np.isin(at, np.asarray(where.values, np.int64)), n))
        return Rolling(chars).at(start, least).view(np.int64), strong(chars, start, least).view(np.int64), start.astype(np.int32)

    open_anchors = hits.join(around, ["doc", "at"], "left_anti").select("h").distinct()
    edges = _of_texts(per_text(hits.join(open_anchors, "h", "left_semi")), "doc long, k1 long, k2 long, at int", spans, "places")
    # a shared neighbourhood makes the spans shared that begin up to ``reach`` before its anchor
    runs = in_several(edges).withColumn("n", F.lit(1)).unionByName(around.select("doc", (F.col("at") - reach).alias("at"), F.lit(reach + 1).alias("n")))
    merged = runs.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("runs")).select("doc", F.explode(_merge(least)("runs")).alias("r")).select("doc", F.col("r.start").alias("span_start"), F.col("r.length").alias("span_length"))
    # copies: the whole text, for the representative too
    whole = docs.join(copies.select("doc"), "doc", "left_semi").select("doc", F.lit(0).alias("span_start"), F.char_length("text").alias("span_length"))
    merged = merged.join(copies.select("doc"), "doc", "left_anti")
    return merged.unionByName(whole.distinct()).withColumnRenamed("doc", id_col)


def _merge(least: int):
    """Runs of starts of shared spans, joined where one begins no later than right after the other."""
    @F.pandas_udf("array<struct<start:int,length:int>>")
    def merge(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            pairs = np.array([(x["at"], x["at"] + x["n"]) for x in g], np.int64)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            top = np.maximum.accumulate(pairs[:, 1])
            cut = np.flatnonzero(np.r_[True, pairs[1:, 0] > top[:-1]])
            ends = top[np.r_[cut[1:] - 1, len(top) - 1]]
            out.append([{"start": int(a), "length": int(b - 1 + least - a)} for a, b in zip(pairs[cut, 0], ends, strict=True)])
        return pd.Series(out)

    return merge


def shared_documents(documents: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of the documents that hold a shared span."""
    return shared_spans(documents, least, id_col, text_col).select(id_col).distinct()


def shared_share(documents: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document its number of spans, the characters they cover (once each) and their share of the text."""
    w = Window.partitionBy(id_col).orderBy("span_start").rowsBetween(Window.unboundedPreceding, -1)
    spans = shared_spans(documents, least, id_col, text_col)
    fresh = F.greatest(F.lit(0), F.col("span_start") + F.col("span_length") - F.greatest(F.col("span_start"), F.coalesce(F.max(F.col("span_start") + F.col("span_length")).over(w), F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy(id_col).agg(F.count("*").alias("n_spans"), F.sum("fresh").alias("shared_chars"))
    sizes = documents.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars_now"))
    out = sizes.join(covered, id_col, "left").na.fill(0, ["n_spans", "shared_chars"])
    return out.withColumn("shared_share", F.when(F.col("n_chars_now") > 0, F.round(F.col("shared_chars") / F.col("n_chars_now"), 6)).otherwise(F.lit(0.0)))
