"""Change detection, four merge strategies, incremental upsert: set operations on snapshots.

A file index is a table of source_path, target_path, content_hash, last_modified, last_imported, file_size, strategy,
patch_fields and source_exists. Detection has two phases: a listing without contents decides most files, and only the
others are read and hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions.text import nz, utrim

STRATEGIES = ("skip", "overwrite", "merge", "patch")
# Fixed value: fields that a patch takes over if none are named.
PATCH_FIELDS = ("title", "description", "tags")
NEW, MISSING, SAME, META, CONTENT = "new_file", "source_missing", "no_change", "meta_changed", "content_changed"
INDEX = "source_path string, target_path string, content_hash string, last_modified timestamp, last_imported timestamp, file_size bigint, strategy string, patch_fields array<string>, source_exists boolean"


def seconds_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6


def fast_detect(listing: DataFrame, index: DataFrame) -> DataFrame:
    """First phase over (source_path, size, mtime): the result, or NULL where contents must be compared.

    Sources that are tracked but not listed are missing; size and time (within a second) both equal mean no change.
    """
    known = index.select("source_path", "target_path", F.col("content_hash").alias("old_hash"), "last_modified", "file_size", "strategy", "patch_fields")
    j = listing.select("source_path", "size", "mtime").join(known, "source_path", "full_outer")
    same = (F.col("size") == F.col("file_size")) & (seconds_apart(F.col("mtime"), F.col("last_modified")) < 1)
    result = F.when(F.col("size").isNull(), MISSING).when(F.col("target_path").isNull(), NEW).when(F.coalesce(same, F.lit(False)), SAME)
    return j.withColumn("result", result)


def detect(listing: DataFrame, contents: DataFrame, index: DataFrame) -> DataFrame:
    """(source_path, target_path, result, new_hash) of every listed or tracked source.

    ``contents`` (source_path, content) is joined with, and hashed for, only those that the first phase left open and
    those that are new; a source that cannot be read counts as changed.
    """
    first = fast_detect(listing, index)
    ask = first.where(F.col("result").isNull() | (F.col("result") == NEW)).select("source_path")
    hashed = contents.join(ask, "source_path", "left_semi").select("source_path", F.sha2("content", 256).alias("new_hash"))
    second = first.join(hashed, "source_path", "left")
    result = F.coalesce("result", F.when(F.col("new_hash") == F.col("old_hash"), META).otherwise(CONTENT))
    return second.select("source_path", "target_path", "size", "mtime", "strategy", "patch_fields", result.alias("result"), "new_hash")


def decide_strategy(forced: str = "") -> Column:
    """Forced before recorded before skip."""
    return F.lit(forced) if forced else F.coalesce(F.nullif(F.col("strategy"), F.lit("")), F.lit("skip"))


# --- frontmatter of one level -----------------------------------------------------------------------------------
# A document is split into scalar fields (map of strings), list fields (map of arrays) and body, all in expressions.


def _rest(text: Column) -> Column:
    return F.when(text.startswith("---\r\n"), F.substring(text, 6, 1 << 30)).otherwise(F.substring(text, 5, 1 << 30))


def _closing(text: Column) -> Column:
    """Where a newline and three hyphens stand after the opening, from 1; 0 if nowhere or without opening."""
    return F.when(text.startswith("---\n") | text.startswith("---\r\n"), F.locate("\n---", _rest(text))).otherwise(0)


def split_frontmatter(text: Column) -> Column:
    """struct(found, scalars map, lists map, body): one level of ``key: value`` and ``- item`` lines.

    Quotes around values are stripped; a key without value begins a list; the last of repeated keys counts.
    """
    end = _closing(text)
    found = end > 0
    block = F.when(found, F.substring(_rest(text), F.lit(1), end - 1)).otherwise("")
    body = F.when(found, F.regexp_replace(F.substring(_rest(text), end + 4, F.lit(1 << 30)), r"\A[\r\n]+", "")).otherwise(text)
    lines = F.filter(F.transform(F.split(block, "\n"), utrim), lambda x: x != "")
    no_map, no_lists = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), F.create_map().cast("map<string,array<string>>")
    start = F.struct(F.lit("").alias("open"), no_map.alias("scalars"), no_lists.alias("lists"))

    def put(m: Column, k: Column, v: Column) -> Column:
        return F.map_concat(F.map_filter(m, lambda a, _: a != k), F.create_map(k, v))

    def step(acc: Column, x: Column) -> Column:
        key = utrim(F.regexp_extract(x, r"(?s)\A([^:]*):", 1))
        value = F.regexp_replace(utrim(F.regexp_extract(x, r"(?s)\A[^:]*:(.*)\z", 1)), "\\A[\"']+|[\"']+\\z", "")
        item, pair = x.startswith("- "), x.contains(":")
        into = item & (acc["open"] != "")
        blank = pair & ~item & (value == "")
        scalar = pair & ~item & (value != "")
        empty = F.array().cast("array<string>")
        return F.struct(
            F.when(blank, key).when(scalar, "").otherwise(acc["open"]).alias("open"),
            F.when(scalar, put(acc["scalars"], key, value)).when(blank, F.map_filter(acc["scalars"], lambda a, _: a != key)).otherwise(acc["scalars"]).alias("scalars"),
            F.when(into, put(acc["lists"], acc["open"], F.concat(F.coalesce(F.try_element_at(acc["lists"], acc["open"]), empty), F.array(F.substring(x, 3, 1 << 30)))))
            .when(blank, put(acc["lists"], key, empty))
            .when(scalar, F.map_filter(acc["lists"], lambda a, _: a != key))
            .otherwise(acc["lists"])
            .alias("lists"),
        )

    parsed = F.aggregate(lines, start, step)
    return F.struct(found.alias("found"), parsed["scalars"].alias("scalars"), parsed["lists"].alias("lists"), body.alias("body"))


def render_frontmatter(scalars: Column, lists: Column, body: Column) -> Column:
    """Keys in byte order, lists as indented items, a newline at the end."""
    keys = F.array_sort(F.array_union(F.map_keys(scalars), F.map_keys(lists)))
    one = lambda k: F.when(
        F.map_contains_key(lists, k), F.concat(k, F.lit(":\n"), F.array_join(F.transform(F.element_at(lists, k), lambda i: F.concat(F.lit("  - "), i, F.lit("\n"))), ""))
    ).otherwise(F.concat(k, F.lit(": "), nz(F.try_element_at(scalars, k)), F.lit("\n")))
    end = F.when((body != "") & ~body.endswith("\n"), "\n").otherwise("")
    return F.concat(F.lit("---\n"), F.array_join(F.transform(keys, one), ""), F.lit("---\n"), body, end)


def _tag_list(m: Column) -> Column:
    """The tags of a document as a list; a scalar counts as one tag."""
    empty = F.array().cast("array<string>")
    scalar = F.try_element_at(m["scalars"], F.lit("tags"))
    return F.coalesce(F.try_element_at(m["lists"], F.lit("tags")), F.when(nz(scalar) != "", F.array(scalar)), empty)


def _merged_fields(s: Column, t: Column) -> Column:
    """The target's fields, the source's further ones, and the union of tags if the source has any."""
    own = lambda k: F.map_contains_key(t["scalars"], k) | F.map_contains_key(t["lists"], k)
    tagged = F.map_contains_key(s["scalars"], F.lit("tags")) | F.map_contains_key(s["lists"], F.lit("tags"))
    mine = lambda m: F.map_filter(m, lambda k, _: ~(tagged & (k == "tags")))
    more = lambda m: F.map_filter(m, lambda k, _: ~own(k) & (k != "tags"))
    lists = F.map_concat(mine(t["lists"]), more(s["lists"]))
    union = F.create_map(F.lit("tags"), F.array_sort(F.array_union(_tag_list(t), _tag_list(s))))
    return F.struct(F.map_concat(mine(t["scalars"]), more(s["scalars"])).alias("scalars"), F.when(tagged, F.map_concat(lists, union)).otherwise(lists).alias("lists"))


def _patched_fields(s: Column, t: Column, fields: Column) -> Column:
    """The target's fields with the named ones of the source in their place."""
    taken = lambda k: F.array_contains(fields, k) & (F.map_contains_key(s["scalars"], k) | F.map_contains_key(s["lists"], k))
    mine = lambda m: F.map_filter(m, lambda k, _: ~taken(k))
    more = lambda m: F.map_filter(m, lambda k, _: F.array_contains(fields, k))
    return F.struct(F.map_concat(mine(t["scalars"]), more(s["scalars"])).alias("scalars"), F.map_concat(mine(t["lists"]), more(s["lists"])).alias("lists"))


def apply_strategies(pairs: DataFrame, forced: str = "") -> DataFrame:
    """``pairs`` (source, target texts, strategy, patch_fields) with the strategy used, the new text and whether it changed.

    A target that is NULL does not exist: every strategy then copies the source. Merge: the target's fields win, new
    ones of the source are added, tags are united, the target's body stays. Patch: only the named fields are taken
    over. Texts without any fields stay as they are.
    """
    if forced and forced not in STRATEGIES:
        raise ValueError(f"no such strategy: {forced}")
    fields = F.when(F.size(F.coalesce("patch_fields", F.array().cast("array<string>"))) > 0, F.col("patch_fields")).otherwise(F.array(*(F.lit(f) for f in PATCH_FIELDS)))
    source, target, used = F.col("source"), F.col("target"), F.col("used")
    parses = target.isNotNull() & used.isin("merge", "patch")
    # a generator of one row keeps the optimizer from writing what a step computes into each place where it is used
    once = lambda c: F.explode(F.array(c))
    s, t = F.col("_s"), F.col("_t")
    merged = F.when(used == "merge", _merged_fields(s, t)).when(used == "patch", _patched_fields(s, t, fields))
    found = F.coalesce(s["found"] | t["found"], F.lit(False))
    rendered = F.when(F.col("_found"), render_frontmatter(F.col("_m.scalars"), F.col("_m.lists"), F.col("_body"))).otherwise(target)
    result = F.when(target.isNull() | (used == "overwrite"), source).when(used == "skip", target).otherwise(rendered)
    read = (
        pairs.withColumn("used", decide_strategy(forced))
        .withColumn("_s", once(F.when(parses, split_frontmatter(source))))
        .withColumn("_t", once(F.when(parses, split_frontmatter(target))))
        .withColumn("_m", once(merged))
        .withColumn("_found", found)
        .withColumn("_body", t["body"])
        .withColumn("result", once(result))
    )
    # a merge of two texts without fields is written again if they differ
    unread = (used == "merge") & ~F.col("_found")
    changed = F.when(target.isNull() | (used == "overwrite"), True).when(used == "skip", False).when(unread, source != target).otherwise(F.col("result") != target)
    return read.withColumn("changed", changed).drop("_s", "_t", "_m", "_found", "_body")


def updated_index(index: DataFrame, detected: DataFrame, now: Column, target: Column | None = None, forced: str = "") -> DataFrame:
    """The file index after an import of ``detected``: also a skipped change is recorded, so it is not offered again."""
    d = detected.select("source_path", F.col("result").alias("r"), F.col("new_hash").alias("h"), F.col("size").alias("n"), F.col("mtime").alias("m"), *([target.alias("t")] if target is not None else [F.lit(None).cast("string").alias("t")]))
    j = index.join(d, "source_path", "full_outer")
    content, new = F.col("r") == CONTENT, F.col("r") == NEW
    touched = content | new | (F.col("r") == META)
    strategy = F.when(content, F.lit(forced) if forced else F.coalesce(F.nullif("strategy", F.lit("")), F.lit("skip"))).when(new, F.lit(forced or "skip")).otherwise(F.col("strategy"))
    return j.select(
        "source_path", F.coalesce("target_path", "t").alias("target_path"), F.when(content | new, F.col("h")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(touched, F.col("m").cast("timestamp")).otherwise(F.col("last_modified")).alias("last_modified"), F.when(content | new, now).otherwise(F.col("last_imported")).alias("last_imported"),
        F.when(touched, F.col("n")).otherwise(F.col("file_size")).alias("file_size"), strategy.alias("strategy"), F.coalesce("patch_fields", F.array().cast("array<string>")).alias("patch_fields"),
        F.when(F.col("r") == MISSING, False).when(touched, True).otherwise(F.col("source_exists")).alias("source_exists"),
    )


def prune_missing(index: DataFrame, detected: DataFrame) -> DataFrame:
    """The index without sources that are gone; entries of archives (``archive::entry``) stay, as only their archive can tell."""
    gone = detected.where((F.col("result") == MISSING) & ~F.col("source_path").contains("::")).select("source_path")
    return index.join(gone, "source_path", "left_anti")


def counters(outcomes: DataFrame) -> DataFrame:
    """One row of counts by outcome: changed, unchanged, missing."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return outcomes.agg(F.count("*").alias("total"), *(count(F.col("result") == r).alias(r) for r in (NEW, MISSING, SAME, META, CONTENT)))


def migrate_index(index: DataFrame) -> tuple[DataFrame, Column]:
    """An index of an older form: sources exist unless they say otherwise; the second part is the time of its last import."""
    fixed = index.withColumn("source_exists", F.coalesce("source_exists", F.lit(True)))
    return fixed, F.max("last_imported")


def add_to_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """Rows appended; a target that is there already is an error."""
    clash = new.join(index.select("target_path"), "target_path", "left_semi").select("target_path").head(1)
    if clash:
        raise ValueError(f"target is tracked already: {clash[0][0]}")
    return index.unionByName(new)


def replace_in_index(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replaced by target; one that is not there is an error."""
    absent = rows.join(index.select("target_path"), "target_path", "left_anti").select("target_path").head(1)
    if absent:
        raise ValueError(f"target is not tracked: {absent[0][0]}")
    return index.join(rows.select("target_path"), "target_path", "left_anti").unionByName(rows)


def delete_from_index(index: DataFrame, targets: DataFrame) -> DataFrame:
    return index.join(targets.select("target_path"), "target_path", "left_anti")


# --- incremental upsert -----------------------------------------------------------------------------------------

# Resources and types of concepts that are made from others, and so rebuilt after each update.
DERIVED_TYPES = ("code_repository", "code_relation_index", "code_context_view")
FILE_RESOURCE = "code://repo/"


def upsert_key() -> Column:
    """Resource, else path; NULL for rows that are only ever appended."""
    return F.when(nz("resource") != "", F.concat(F.lit("r:"), "resource")).when(nz("file_path") != "", F.concat(F.lit("f:"), "file_path"))


def upsert(existing: DataFrame, incremental: DataFrame) -> DataFrame:
    """``existing`` with the rows of ``incremental`` in place of those with their key, the last of each key; tombstones (type ``deleted``) remove.

    A tombstone of ``p`` removes both the resource ``p`` and the file resource of ``p``, whichever came before it.
    Rows made from others are dropped; they are to be rebuilt.
    """
    plain = ~F.coalesce(F.col("type").isin(*DERIVED_TYPES), F.lit(False))
    cols = existing.columns
    old = existing.where(plain).select("*", F.lit(0).alias("_round"))
    new = incremental.where(plain).select(*cols, F.lit(1).alias("_round"))
    dead = nz("type") == "deleted"
    names = F.when(dead, F.array(F.concat(F.lit("r:"), nz("resource")), F.concat(F.lit("r:" + FILE_RESOURCE), nz("resource")))).otherwise(F.array(upsert_key()))
    keyed = old.unionByName(new).withColumn("_key", F.explode(names))
    # the contents of what is replaced are not sorted: the last of each key is found by a maximum
    last = keyed.where("_key is not null").groupBy("_key").agg(F.max(F.struct("_round", "ord")).alias("_last"))
    kept = keyed.where(F.col("_key").isNotNull()).join(last, "_key").where((F.struct("_round", "ord") == F.col("_last")) & ~dead)
    return kept.select(*cols).unionByName(keyed.where(F.col("_key").isNull() & ~dead).select(*cols))


def trusted_to_delete(generator: str) -> Column:
    """Whether a concept's file may be removed with its source: it says that it was generated, by whom, and from that source."""
    field = lambda k: nz(F.try_element_at("custom", F.lit(k)))
    source = field("source_path")
    return (F.lower(field("generated")) == "true") & (field("generator") == generator) & (source != "") & ((source == F.col("resource")) | (F.concat(F.lit(FILE_RESOURCE), source) == F.col("resource")))


def tombstones(changed: DataFrame, present: DataFrame) -> DataFrame:
    """(path, deleted): which of the changed paths are there no more."""
    return changed.join(present.select("path").distinct().withColumn("_here", F.lit(True)), "path", "left").select("path", F.col("_here").isNull().alias("deleted"))


def newest_first(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The first row of each group in an order."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
