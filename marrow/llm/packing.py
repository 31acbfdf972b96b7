"""Filling containers of a fixed capacity with items of varying length.

Only how many items there are of each size decides how containers are filled, and there are no more sizes than the
capacity. So the sizes are counted by Spark, the plan is made over that histogram (bounded by the capacity, however
many items there are), and items take their places by size and rank in one more pass.

The plan: a container begins with the largest size left. While its gap has no exact complement (one size, a pair or a
triple of sizes that sum to the gap, looked up in indexes of present sizes, of pair sums and of triple sums, under the
counts still available) the largest size that fits is added; an exact complement closes the container without a unit unused.
The same filling is repeated as often as the counts allow, so every filling uses up a size. What no exact complement
takes is filled best-fit.

Items above the capacity are cut into full containers and a rest, which is packed like other items; no other item is
split.

Defined cases: items of size 0 (NULL and empty texts) take no space and come out with container 0; an empty table
gives no rows; equal sizes are ranked by a hash and the id, so the result does not depend on the order of rows;
repeated ids are items of their own. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions.session import written

#: Ranks within a size are counted in so many parts, so that no size is one task's burden.
PARTS = 1024

#: First sizes of a triple that are tried before the index of pair sums is made anew.
TRIES = 64


@dataclass(frozen=True)
class Filling:
    """``times`` containers from ``first`` on, each holding ``sizes`` (size and how often)."""

    first: int
    times: int
    sizes: tuple[tuple[int, int], ...]


class _Sums:
    """Indexes of the sizes present and of the sums of two and of three of them; they may hold sums that counts no longer allow."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.refresh()

    def refresh(self) -> None:
        self.stale = 0
        present = (self.counts > 0).astype(np.float64)
        n = 1 << int(3 * len(present)).bit_length()
        f = np.fft.rfft(present, n)
        self.pair, self.triple = (np.rint(np.fft.irfft(f**k, n)[: len(present)]).astype(np.int64) > 0 for k in (2, 3))

    def _allowed(self, have: np.ndarray, used: Counter) -> bool:
        return all(have[s] >= k for s, k in used.items())

    def exact(self, gap: int, held: Counter) -> tuple[int, ...] | None:
        """One, two or three sizes that sum to ``gap`` and are there beside those held."""
        c = self.counts
        if c[gap] > held[gap]:
            return (gap,)
        free = c[: gap + 1].copy()
        for s, k in held.items():
            if s <= gap:
                free[s] -= k
        if self.pair[gap] and (p := self._pair(free, gap)):
            return p
        if not self.triple[gap]:
            return None
        firsts = self._firsts(free, gap)
        if len(firsts) > TRIES:  # many in vain: the sums are out of date, and the rest is tried by those there are now
            if p := self._triple(free, gap, firsts[:TRIES]):
                return p
            self.refresh()
            last = firsts[TRIES - 1]
            firsts = [a for a in self._firsts(free, gap) if a < last]
        p = self._triple(free, gap, firsts)
        if self.stale > 2000:
            self.refresh()
        return p

    def _firsts(self, free: np.ndarray, gap: int) -> list[int]:
        """Sizes that a sum of two may complete to ``gap``, the largest first."""
        return (np.flatnonzero((free[1:gap] > 0) & self.pair[gap - 1 : 0 : -1]) + 1)[::-1].tolist()

    def _triple(self, free: np.ndarray, gap: int, firsts: list[int]) -> tuple[int, int, int] | None:
        for a in firsts:
            free[a] -= 1
            p = self._pair(free, gap - a)
            free[a] += 1
            if p:
                return (a, *p)
            self.stale += 1
        return None

    @staticmethod
    def _pair(free: np.ndarray, total: int) -> tuple[int, int] | None:
        half = total // 2
        if total < 2:
            return None
        low = np.arange(1, half + 1)
        ok = (free[1 : half + 1] > 0) & (free[total - 1 : total - half - 1 : -1] > 0)
        if total % 2 == 0 and free[half] < 2:
            ok[-1] = False
        hit = np.flatnonzero(ok)
        if not len(hit):
            return None
        a = int(low[hit[0]])
        return total - a, a


def plan(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Fillings for ``counts`` of each size from 1 to ``capacity``."""
    have = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        have[s] = n
    index = _Sums(have)
    out: list[Filling] = []
    sizes = np.flatnonzero(have).tolist()
    first = 0
    while sizes:
        if not have[sizes[-1]]:
            sizes.pop()
            continue
        held: Counter = Counter({sizes[-1]: 1})
        gap = capacity - sizes[-1]
        while gap:
            if found := index.exact(gap, held):
                held.update(found)
                break
            at = bisect_right(sizes, gap) - 1
            while at >= 0 and have[sizes[at]] <= held[sizes[at]]:
                if not have[sizes[at]]:
                    sizes.pop(at)
                at -= 1
            if at < 0:
                break
            held[sizes[at]] += 1
            gap -= sizes[at]
        times = int(min(have[s] // k for s, k in held.items()))
        for s, k in held.items():
            have[s] -= times * k
        out.append(Filling(first, times, tuple(sorted(held.items()))))
        first += times
    return out


def _places(fillings: list[Filling]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each size, by rank: where each filling's items begin, its first container, and how many items a container takes."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    at: Counter = Counter()
    for f in fillings:
        for s, k in f.sizes:
            rows.setdefault(s, []).append((at[s], f.first, k))
            at[s] += f.times * k
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(id, part, first_unit, size, container) for every item of ``sizes``, which is read twice."""
    base = sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("n"))
    full = F.floor(F.col("n") / capacity)
    rest = F.when((F.col("n") % capacity > 0) | (F.col("n") == 0), F.array(F.col("n") % capacity)).otherwise(F.array().cast("array<bigint>"))
    parts = base.select("id", F.posexplode(F.concat(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")), rest)).alias("part", "size"))
    salt = F.pmod(F.xxhash64("id", "part"), F.lit(PARTS)).cast("int")
    items = parts.withColumn("salt", salt)
    per_part = items.where("size > 0").groupBy("size", "salt").agg(F.count("*").alias("m"))
    totals = {r["size"]: r["m"] for r in per_part.groupBy("size").agg(F.sum("m").alias("m")).collect()}  # at most ``capacity`` rows
    fillings = plan(totals, capacity)
    places = sizes.sparkSession.sparkContext.broadcast(_places(fillings))  # bounded by the capacity
    # rank of an item in its size: how many there are in earlier parts, and its rank in its own part
    before = per_part.withColumn("before", F.sum("m").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("size", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = items.withColumn("r", F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "part")) - 1).join(before, ["size", "salt"], "left")
    ranked = ranked.select("id", "part", "size", (F.col("r") + F.coalesce("before", F.lit(0))).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            size, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            container = np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows) and size[rows[0]] > 0:
                    begin, first, k = table[int(size[rows[0]])]
                    f = np.searchsorted(begin, rank[rows], side="right") - 1
                    container[rows] = first[f] + (rank[rows] - begin[f]) // k[f]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(container)], names=["id", "part", "size", "container"])

    kind = base.schema["id"].dataType.simpleString()
    out = ranked.mapInArrow(place, f"id {kind}, part int, size long, container long")
    return out.select(F.col("id").alias(id_col), "part", (F.col("part").cast("long") * capacity).alias("first_unit"), "size", "container")


def pack_texts(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Texts sized in tokens of a public tokenizer; they are tokenised once, and the sizes written."""
    from marrow.llm.bpe import token_counts

    return pack(written(token_counts(docs, id_col, text_col, tokenizer), "sizes"), capacity, id_col)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, units held, share of the space unused, containers without a unit unused."""
    used = packed.where("size > 0").groupBy("container").agg(F.sum("size").alias("used"))
    return used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("units"), F.coalesce(F.sum((F.col("used") == capacity).cast("long")), F.lit(0)).alias("full"), F.coalesce(F.max("used"), F.lit(0)).alias("most")).withColumn(
        "unused_share", F.when(F.col("containers") > 0, F.round(1 - F.col("units") / (F.col("containers") * capacity), 6)).otherwise(F.lit(0.0))
    )
