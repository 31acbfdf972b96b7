"""Oversized items cut into pieces at natural boundaries, with an exact overlap.

The offsets of an item's units (characters, or tokens of a tokenizer) are a prefix sum; its natural boundaries are
sorted arrays, one for each strength (headings before paragraphs before lines before sentences before words; in code:
outer declarations before blank lines before lines). The end of a piece is found by binary search: the last boundary
under the limit, of the strongest kind that keeps at least half of the limit; without any there, the last boundary of
any kind beyond the overlap; without any at all, a hard cut that splits no CRLF and no combined character. The next
piece begins ``overlap`` units before that end. All boundaries are found in time linear in the text.

Defined cases: NULL and empty contents and contents within the limit are one piece or, with ``only_oversized``, none;
a missing or unknown file path means prose; items delivered again (same key) come out once, by their latest delivery
(NULL is the oldest, ties are settled by a hash of the content), so not at all if that one is within the limit;
``overlap`` must be below half of ``limit``; whole contents are cut whatever their length; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE = {"go", "py", "js", "jsx", "ts", "tsx", "java", "rs", "rb", "c", "h", "cc", "cpp", "hpp", "cs", "php", "kt", "swift", "scala", "sh"}
LINES = {"csv", "tsv", "log", "json", "jsonl", "ndjson", "yaml", "yml", "toml", "ini", "lock", "diff", "patch", "sql"}

_FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n]*$", re.M)
_HEADING = re.compile(r"^(?=#{1,6}[ \t])", re.M)
_FILLED = re.compile(r"^[^\S\n]*+\S", re.M)
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?;][\"')\]]*[ \t]+|[。！？；][”’」』）]*")
_WORD = re.compile(r"\s+")
_PROSE_KINDS, _CODE_KINDS, _LINE_KINDS = ("heading", "paragraph", "line", "sentence", "word"), ("declaration", "blank_line", "line", "sentence", "word"), ("line", "sentence", "word")


def kind_of(file_path: str | None) -> str:
    ext = (file_path or "").rpartition("/")[2].rpartition(".")[2].lower()
    return "code" if ext in CODE else "lines" if ext in LINES else "prose"


def _ends(pattern: re.Pattern, text: str) -> np.ndarray:
    return np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)


def _after_blank(text: str) -> np.ndarray:
    """Where lines begin that are not blank and follow a blank one."""
    filled = np.fromiter((m.start() for m in _FILLED.finditer(text)), np.int64)
    number = np.searchsorted(_ends(_LINE, text), filled, side="right")
    return filled[1:][np.diff(number) > 1]


def _outer(text: str, at: np.ndarray) -> np.ndarray:
    """Those of the line beginnings ``at`` whose line is not indented and closes no bracket."""
    return at[np.fromiter((text[k] not in "})]" and not text[k].isspace() for k in at), bool, len(at))]


def _outside_fences(text: str, at: np.ndarray) -> np.ndarray:
    """Those offsets that do not lie within a fenced block of code."""
    marks = [m.start() for m in _FENCE.finditer(text)]
    if not marks or not len(at):
        return at
    return at[np.searchsorted(np.array(marks), at, side="left") % 2 == 0]


def boundaries(text: str, kind: str) -> list[tuple[str, np.ndarray]]:
    """Sorted offsets at which a text of that kind may be cut, the strongest kind of boundary first."""
    if kind == "code":
        blank = _after_blank(text)
        return list(zip(_CODE_KINDS, (_outer(text, blank), blank, _ends(_LINE, text), _ends(_SENTENCE, text), _ends(_WORD, text)), strict=True))
    if kind == "lines":
        return list(zip(_LINE_KINDS, (_ends(_LINE, text), _ends(_SENTENCE, text), _ends(_WORD, text)), strict=True))
    return list(zip(_PROSE_KINDS, (_outside_fences(text, _ends(_HEADING, text)), _outside_fences(text, _after_blank(text)), _ends(_LINE, text), _ends(_SENTENCE, text), _ends(_WORD, text)), strict=True))


def _hard(text: str, low: int, end: int) -> int:
    """A cut at ``end`` or a few characters before it that splits no CRLF and no combined character."""
    at = end
    while at > low and at < len(text) and ((text[at] == "\n" and text[at - 1] == "\r") or unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d"):
        at -= 1
    return at if at > low else end


def pieces(text: str, kind: str, limit: int, overlap: int, offsets: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """(start, end, boundary) in characters of each piece; ``offsets``, if given, are the character offsets of units.

    ``offsets[k]`` is where unit k begins and its last entry is the length of the text.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be below half of the limit")
    # in characters the prefix sum is the identity and needs no array
    n = len(text) if offsets is None else len(offsets) - 1
    char = (lambda u: u) if offsets is None else (lambda u: int(offsets[u]))
    levels: list[tuple[str, np.ndarray]] | None = None
    out, start = [], 0
    while n - start > limit:
        if levels is None:
            levels = [(name, at if offsets is None else _units_at(offsets, at)) for name, at in boundaries(text, kind)]
        low, high = start + max(overlap, limit // 2), start + limit
        lasts = [(int(at[k]), name) for name, at in levels if (k := int(np.searchsorted(at, high, side="right")) - 1) >= 0]
        if found := next((x for x in lasts if x[0] > low), None) or max((x for x in lasts if x[0] > start + overlap), key=lambda x: x[0], default=None):
            end, name = found
        else:
            name, end = "hard", high
            if offsets is None:
                end = _hard(text, low, high)
        out.append((char(start), char(end), name))
        start = end - overlap
    out.append((char(start), len(text), "end"))
    return out


def _units_at(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Units that begin exactly at a boundary."""
    k = np.searchsorted(offsets, at)
    return np.unique(k[offsets[np.minimum(k, len(offsets) - 1)] == at])


def split_offsets(limit: int, overlap: int, tokenizer: str | None = None):
    """A column function of content and file path: the pieces' offsets; in tokens if a tokenizer's path is given."""

    @F.pandas_udf("array<struct<piece_no:int,start:int,end:int,boundary:string>>")
    def cut(content: pd.Series, path: pd.Series) -> pd.Series:
        out = []
        for text, p in zip(content, path, strict=True):
            if not text:
                out.append([])
                continue
            units = None
            if tokenizer:
                from marrow.llm.bpe import token_offsets

                units = token_offsets(text, tokenizer)
            out.append([{"piece_no": k, "start": a, "end": b, "boundary": name} for k, (a, b, name) in enumerate(pieces(text, kind_of(p), limit, overlap, units))])
        return pd.Series(out, dtype=object)

    return cut


def split_oversized(items: DataFrame, limit: int, overlap: int, key: str = "ord", content: str = "content", path: str = "file_path", only_oversized: bool = True, tokenizer: str | None = None, text: bool = False, version: str | None = "loaded_at") -> DataFrame:
    """(key, piece_no, start, length, boundary[, piece]) of each item, in characters from 0, one row per piece and key.

    Items are cut where they are read; of each delivery only offsets are shuffled to choose the latest by ``version`` (if there is such a column),
    unless ``text`` asks for the pieces themselves.
    """
    taken = F.col(content)
    if only_oversized and not tokenizer:
        taken = F.when(F.char_length(content) > limit, taken)
    rank = F.struct(*([F.col(version).alias("v")] if version in items.columns else []), F.xxhash64(content).alias("h"))
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), taken.alias("c"), F.col(path).alias("p"), rank.alias("rank"))
    cut = rows.select("k", "rank", split_offsets(limit, overlap, tokenizer)("c", "p").alias("cut"), *(["c"] if text else []))
    last = cut.groupBy("k").agg(F.max_by(F.struct("cut", *(["c"] if text else [])), "rank").alias("x"))
    got = last.select("k", F.explode("x.cut").alias("x"), *([F.col("x.c").alias("c")] if text else []))
    if only_oversized and tokenizer:
        got = got.where((F.col("x.piece_no") > 0) | (F.col("x.boundary") != "end"))
    return got.select(F.col("k").alias(key), F.col("x.piece_no").alias("piece_no"), F.col("x.start").alias("start"), (F.col("x.end") - F.col("x.start")).alias("length"), F.col("x.boundary").alias("boundary"), *([F.expr("substring(c, x.start + 1, x.end - x.start)").alias("piece")] if text else []))
