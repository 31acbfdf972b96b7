"""Items that appear together: a blocked Gram matrix of baskets and items, and how far it exceeds chance.

Baskets are read in record blocks. A block becomes a binary sparse matrix of records and items (its own numbering of
the items it holds); the product of its transpose with itself counts each pair of items, and the diagonal counts the
items. Products are summed over the record blocks of a task before anything is shuffled, then by Spark. Within a
block the product is made in slices of a bounded number of entries, so a basket with very many items needs no more
memory than others.

Defined cases: NULL baskets and NULL or blank items are no items; an item repeated in a basket counts once; baskets
that are delivered again (same key) count once, by their latest delivery; baskets without items count among all
records; an empty table gives no pairs. Ties have no effect. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.functions.session import written

#: Entries of a product made at once, and sums of products kept before they are passed on.
SLICE, KEPT = 1 << 20, 1 << 21


def tag_key(tag: Column) -> Column:
    """Lower case, cut at whitespace, hyphens and underscores, joined by single hyphens."""
    return F.array_join(F.filter(F.split(F.lower(tag), r"(?U)[\s\-_]+"), lambda x: x != ""), "-")


def _gram_of_block(record: np.ndarray, item: np.ndarray, n_items: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries (a * n_items + b, count) of the product, a before b in the block's order, in slices.

    ``record`` is sorted; entry k of a record meets the entries from itself to the record's last.
    """
    n = len(record)
    last = np.searchsorted(record, record, side="right")
    width = last - np.arange(n)
    ends = np.cumsum(width)
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, side="right")))
        w = width[begin:end]
        left = np.repeat(np.arange(begin, end), w)
        right = left + (np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w))
        a, b = item[left], item[right]
        key, count = np.unique(np.minimum(a, b) * n_items + np.maximum(a, b), return_counts=True)
        yield key, count
        begin = end


def gram(baskets: DataFrame) -> DataFrame:
    """(item_a, item_b, n) of distinct pairs of items with ``item_a <= item_b`` in code-point order; (NULL, NULL, n) counts the records.

    ``baskets`` has one column, an array of distinct items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        number: dict[str, int] = {}
        keys, counts, size, records = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            order = np.empty(len(names), np.int64)
            order[np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)] = np.arange(len(names))
            a, b = k >> 31, k & ((1 << 31) - 1)
            swap = order[a] > order[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            words = pa.array(names, pa.string())
            return pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), pa.array(n)], names=["item_a", "item_b", "n"])

        for batch in batches:
            lists = batch.column(0)
            records += len(lists)
            flat = lists.flatten()
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            local = np.array([number.setdefault(x, len(number)) for x in coded.dictionary.to_pylist()], np.int64)
            names.extend(list(number)[len(names) :])
            item = local[coded.indices.to_numpy(zero_copy_only=False)]
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            record = np.repeat(np.arange(len(lists)), lengths)
            passed_on = False
            for k, n in _gram_of_block(record, item, 1 << 31):
                keys.append(k)
                counts.append(n)
                size += len(k)
                if size > KEPT:
                    k, at = np.unique(np.concatenate(keys), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate(counts))
                    keys, counts, size = [k], [n], len(k)
                    if size > KEPT // 2:
                        yield flush()
                        keys, counts, size, passed_on = [], [], 0, True
            if passed_on:  # only now: the numbering holds for all slices of a batch
                if size:
                    yield flush()
                keys, counts, size, names, number = [], [], 0, [], {}
        if size:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([records], pa.int64())], names=["item_a", "item_b", "n"])

    return baskets.mapInArrow(run, "item_a string, item_b string, n long").groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))


def together(table: DataFrame, key: str = "ord", items: str = "tags", version: str | None = "loaded_at", item_key=tag_key, least: int = 5) -> DataFrame:
    """Pairs (item_a, item_b, n_ab, n_a, n_b, n, lift) that stand together in at least ``least`` records.

    ``lift`` is the count over what independent items would give.
    """
    cleaned = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(items), F.array().cast("array<string>")), item_key), lambda x: x.isNotNull() & (x != "")))
    rows = table.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), cleaned.alias("items"), *([F.coalesce(F.col(version).cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("v")] if version else []))
    latest = rows.groupBy("k").agg((F.max_by("items", F.struct("v", "items")) if version else F.max("items")).alias("items"))
    # an item of such a pair stands in as many records itself, so what is below ``least`` is not needed on
    counts = written(gram(latest.select("items")).where((F.col("n") >= least) | F.col("item_a").isNull()), "gram")
    single = counts.where("item_a = item_b")
    pairs = counts.where((F.col("item_a") < F.col("item_b")) & (F.col("n") >= least)).withColumnRenamed("n", "n_ab")
    total = counts.where("item_a is null").agg(F.sum("n").alias("n"))
    out = (
        pairs.join(single.select("item_a", F.col("n").alias("n_a")), "item_a")
        .join(single.select("item_b", F.col("n").alias("n_b")), "item_b")
        .join(F.broadcast(total))  # one row
    )
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", (F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"))


def unusually_often(table: DataFrame, times: int = 3, least: int = 5, **kw) -> DataFrame:
    """The pairs whose count is at least ``times`` what independent items would give, compared in whole numbers."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return together(table, least=least, **kw).where(wide("n_ab") * wide("n") >= F.lit(times) * wide("n_a") * wide("n_b"))
