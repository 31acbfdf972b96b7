"""Byte-level BPE of a whole corpus by a lazily determinised finite-state transducer.

The merge table is compiled into a trie of tokens and a compatibility test for neighbours: two tokens may stand side
by side only if no merge ever crosses their border. Then the encoding of every prefix of a word is the encoding of a
shorter prefix plus one compatible token, and only prefixes from which a token can still grow matter. A state of the
transducer is that set of live prefixes, each with its place in the trie and with the tokens not yet emitted; states
and transitions are made the first time a byte leads to them and kept until there are ``TRANSITIONS``; then all but the
state at hand are forgotten, in the middle of a word too, and made again as needed. What all live
prefixes agree upon is emitted, so output lags by at most one longest token. Decoding streams through an incremental
UTF-8 state machine.

Defined cases: NULL and empty texts give an empty list; strings that look like control tokens are ordinary text and
special tokens are never produced; whole texts are encoded, whatever their length; lone surrogates cannot occur in
Spark strings; repeated ids give a row each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import os
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Words remembered by a worker with their ids; when full, the memory is emptied. It changes no result.
MEMO_WORDS = 400_000
#: Transitions, and borders between tokens, that a worker keeps. They change no result either.
TRANSITIONS, BORDERS = 400_000, 400_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", directory: str | None = None) -> str:
    return os.path.join(directory or os.environ.get("MARROW_TOKENIZERS", TOKENIZER_DIR), name)


def word_pattern() -> str:
    """The pattern that cuts a text into words before merges apply (public, of the first byte-level BPE)."""
    return r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Transducer:
    """States are numbers; ``_next[state]`` maps a byte to the next state and what is emitted on the way."""

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None):
        import regex

        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._trie: list[dict[int, int]] = [{}]
        self._token: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self._trie[node].get(b)
                if nxt is None:
                    nxt = self._trie[node][b] = len(self._trie)
                    self._trie.append({})
                    self._token.append(-1)
                node = nxt
            self._token[node] = rank
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._index: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._next: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self._end: list[tuple[int, ...]] = []
        self._forget()
        self._words = regex.compile(pattern or word_pattern()).findall
        self._memo: dict[str, tuple[int, ...]] = {}

    def _forget(self) -> None:
        """Back to the first state alone; tables stay the same objects."""
        self._made = 0
        for table in (self._index, self._states, self._next, self._end):
            table.clear()
        self._state((-1, ((0, ()),)), ())

    def _state(self, key: tuple, end: tuple[int, ...]) -> int:
        to = self._index.get(key)
        if to is None:
            to = self._index[key] = len(self._states)
            self._states.append(key)
            self._next.append({})
            self._end.append(end)
        return to

    @classmethod
    def load(cls, path: str, pattern: str | None = None) -> Transducer:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self._parts:
            pieces = [bytes([b]) for b in self.bytes_of[token]]
            while len(pieces) > 2:
                best, at = min(((self.ranks.get(pieces[k] + pieces[k + 1], 1 << 60), k) for k in range(len(pieces) - 1)), default=(1 << 60, 0))
                if best >= token:
                    break
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            self._parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return self._parts[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both ends with exactly these two tokens."""
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) >= BORDERS:
                self._fits.clear()
            known = self._fits[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # pieces that touch the border, from whole token down to byte; a piece lives until its parent is merged
        ls, rs = [left], [right]
        while p := self._split(ls[-1]):
            ls.append(p[1])
        while p := self._split(rs[-1]):
            rs.append(p[0])
        i, j = len(ls) - 1, len(rs) - 1
        while True:
            ends_left = ls[i - 1] if i else 1 << 60
            ends_right = rs[j - 1] if j else 1 << 60
            merged = self.ranks.get(self.bytes_of[ls[i]] + self.bytes_of[rs[j]])
            # of equal ranks the left one is merged first
            if merged is not None and merged < ends_left and merged <= ends_right:
                return False
            if not i and not j:
                return True
            if ends_left <= ends_right:
                i -= 1
            else:
                j -= 1

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        if self._made >= TRANSITIONS:
            here, end = self._states[state], self._end[state]
            self._forget()
            state = self._state(here, end)
        self._made += 1
        prev, live = self._states[state]
        grown: list[tuple[int, tuple[int, ...]]] = []
        ended: tuple[int, ...] | None = None
        for node, path in live:
            child = self._trie[node].get(byte)
            if child is None:
                continue
            if self._trie[child]:
                grown.append((child, path))
            token = self._token[child]
            if token >= 0 and ended is None:
                before = path[-1] if path else prev
                if before < 0 or self.fits(before, token):
                    ended = (*path, token)
        if ended is None:
            raise ValueError(f"byte {byte} is not covered by the vocabulary")
        grown.append((0, ended))
        agreed = os.path.commonprefix([path for _, path in grown])
        emitted = tuple(agreed)
        cut = len(emitted)
        rest = tuple((node, path[cut:]) for node, path in grown)
        last = emitted[-1] if emitted else prev
        key = (last if any(not path for _, path in rest) else -2, rest)
        to = self._state(key, rest[-1][1])
        self._next[state][byte] = (to, emitted)
        return to, emitted

    def encode_bytes(self, word: bytes) -> tuple[int, ...]:
        state, out, table = 0, [], self._next
        for b in word:
            hit = table[state].get(b)
            if hit is None:
                hit = self._step(state, b)
            state = hit[0]
            if hit[1]:
                out += hit[1]
        out += self._end[state]
        return tuple(out)

    def encode_into(self, text: str, out: array) -> None:
        memo = self._memo
        for word in self._words(text):
            ids = memo.get(word)
            if ids is None:
                ids = self.encode_bytes(word.encode("utf-8"))
                if len(word) <= 64:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are whole; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for k in ids:
            if piece := machine.decode(self.bytes_of[k]):
                yield piece
        if piece := machine.decode(b"", final=True):
            yield piece

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a worker process: compiled once, its states kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Transducer.load(path)
    return _loaded[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ``ids``, a list of token ids, of each row; a map without a shuffle."""
    where = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(where)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            keep = batch.column(0)
            done = 0
            for k, text in enumerate(batch.column(1)):
                value = text.as_py()
                if value:
                    t.encode_into(value, flat)
                ends.append(len(flat))
                if len(flat) > 4_000_000:  # a batch of long texts comes out in parts
                    yield _lists(keep.slice(done, k + 1 - done), ends, flat)
                    flat, ends, done = array("i"), array("i", [0]), k + 1
            if len(ends) > 1:
                yield _lists(keep.slice(done), ends, flat)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", id_col)


def _lists(keys: pa.Array, ends: array, flat: array) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays([keys, lists], names=["k", "ids"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ``n_tokens`` of each row, without sending the ids."""
    where = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(where)
        for batch in batches:
            sizes = []
            for text in batch.column(1):
                value, flat = text.as_py(), array("i")
                if value:
                    t.encode_into(value, flat)
                sizes.append(len(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["k", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, n_tokens long").withColumnRenamed("k", id_col)


def token_offsets(text: str, path: str):
    """Where each token begins, in characters, and at last the length of the text; a token inside a character begins at the next one."""
    import numpy as np

    t = transducer(path)
    sizes = np.array([len(t.bytes_of[k]) for k in t.encode(text)], np.int64)
    begins = np.r_[0, np.cumsum(sizes)]
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return before[begins]
