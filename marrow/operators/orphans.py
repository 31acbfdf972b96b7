"""References to records that do not exist: direct orphans, and those that inherit the fault.

A reference is orphaned directly if no life of its target covers the moment it was seen. Then a fixpoint runs down the
graph of references: a record that holds an orphaned reference is itself faulty, so references to it are orphaned
indirectly, one level further each round, by semi-joins of the references not yet reached with the last round's
records, which are known by their ids and by their external ids. References and rounds are written to the shared folder,
so lineage stays short and references are shuffled once.

Defined cases: blank keys (NULL, empty, whitespace) are no reference; keys are compared without surrounding
whitespace and otherwise exactly; references delivered again count once; duplicate lives of a target have no effect;
a NULL begin is since always and a NULL end is never; a NULL moment is covered only by a target that is live at all times;
a record's external ids are those of all its lives, and one that several records share is faulty if one of them is;
cycles end the fixpoint like any record already reached; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.functions.session import Growing, bucketed, buckets_for, written
from marrow.functions.skew import all_salts, hot_keys, salt_of, salted_join, salts


_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without surrounding whitespace of any kind; NULL stays NULL."""
    return F.trim(c, F.lit(_BLANKS))


def _key(space: str, c: Column) -> Column:
    # one string per space of keys, so that one equi-join serves both
    return F.when(stripped(c) != "", F.concat(F.lit(space + ":"), stripped(c)))


def references(relations: DataFrame) -> DataFrame:
    """(relation_id, source, key, seen_at): one row per relation that has a target."""
    key = F.coalesce(_key("id", F.col("target_id")), _key("ext", F.col("target_ref")))
    return relations.select("relation_id", F.col("source_entity_id").alias("source"), key.alias("key"), "seen_at").where(F.col("key").isNotNull())


def lives(entities: DataFrame, library: DataFrame) -> DataFrame:
    """(key, begins, ends) of every life of every target, under its id and under its external id."""
    own = entities.select("entity_id", "external_id", F.col("indexed_at").alias("begins"), F.col("deleted_at").alias("ends"))
    always = library.select("entity_id", "external_id", F.lit(None).cast(own.schema["begins"].dataType).alias("begins"), F.lit(None).cast(own.schema["ends"].dataType).alias("ends"))
    rows = own.unionByName(always)
    keys = F.explode(F.array_compact(F.array(_key("id", F.col("entity_id")), _key("ext", F.col("external_id")))))
    return rows.select(keys.alias("key"), "begins", "ends").distinct()


def aliases(entities: DataFrame, library: DataFrame) -> DataFrame:
    """(key, alias): the key of every target's id with the key of each of its external ids."""
    rows = entities.select("entity_id", "external_id").unionByName(library.select("entity_id", "external_id"))
    return rows.select(_key("id", F.col("entity_id")).alias("key"), _key("ext", F.col("external_id")).alias("alias")).where("key is not null and alias is not null").distinct()


def _covers() -> Column:
    begins, ends, seen = F.col("f.begins"), F.col("f.ends"), F.col("m.seen_at")
    return (begins.isNull() | (begins <= seen)) & (ends.isNull() | (seen < ends))


_PLACE = ["key", "salt"]  # what references are laid out by: rows of a hot key stand in several parts


class Checked:
    """The references, each with ``reason`` if it is orphaned directly, else NULL, laid out once for all that follows.

    References are shuffled once, by key and salt; the lives of the targets meet them there, and the rounds of the
    fixpoint and the final join read the written table without another shuffle of it.
    """

    def __init__(self, relations: DataFrame, entities: DataFrame, library: DataFrame):
        spark = relations.sparkSession
        refs = references(relations)
        hot, n = hot_keys(refs, "key"), salts(spark)
        self.all_salts = all_salts("key", hot, n)
        self.buckets = buckets_for(relations)
        placed = refs.withColumn("salt", salt_of("key", "relation_id", hot, n)).repartition(self.buckets, *_PLACE).distinct()
        known = self.spread(lives(entities, library))
        here = [F.col(f"f.{c}") == F.col(f"m.{c}").outer() for c in _PLACE]
        begins, ends, seen = F.col("f.begins"), F.col("f.ends"), F.col("m.seen_at").outer()
        live = known.alias("f").where(here[0] & here[1] & (begins.isNull() | (begins <= seen)) & (ends.isNull() | (seen < ends))).exists()
        spans = known.groupBy(*_PLACE).agg(F.min("begins").alias("first"), F.max(_end()).alias("last"))
        rows = placed.alias("m").select("*", live.alias("live")).join(spans, _PLACE, "left")
        self.rows = bucketed(rows.select("relation_id", "source", "key", "salt", "seen_at", F.when(~F.col("live"), _reason()).alias("reason")), "references", _PLACE, self.buckets)
        self.names = aliases(entities, library)

    def spread(self, rows: DataFrame) -> DataFrame:
        """Rows by key, repeated for each salt that references of the key may have."""
        return rows.withColumn("salt", F.explode(self.all_salts))

    def levels(self) -> DataFrame:
        """The references with ``level``: 0 for direct orphans, above it for inherited faults, NULL for sound ones."""
        sound = self.rows.where("reason is null")
        records = fixpoint(self.rows.where("reason is not null").select("source"), sound, self.names, self.spread, lambda df: bucketed(df, "edges", _PLACE, self.buckets))
        joined = self.rows.join(self.spread(records).withColumnRenamed("level", "of_target"), _PLACE, "left")
        return joined.withColumn("level", F.when(F.col("reason").isNotNull(), 0).otherwise(F.col("of_target") + 1)).drop("of_target", "salt")


def _end() -> Column:
    return F.coalesce("ends", F.lit("9999-12-31").cast("timestamp_ntz"))


def _reason() -> Column:
    return F.when(F.col("last").isNull(), "missing").when(F.col("first") > F.col("seen_at"), "later").when(F.col("last") <= F.col("seen_at"), "deleted").otherwise("between")


def fixpoint(faulty: DataFrame, edges: DataFrame, names: DataFrame | None, spread, lay, most_rounds: int | None = None) -> DataFrame:
    """(key, level) of every faulty record under all its keys, from those that are faulty at once.

    ``faulty`` has the ``source`` of the direct orphans, ``edges`` source, key and salt of the other references, laid
    out by key and salt. Only edges to records that hold references themselves can pass a fault on, so the others are
    left out before the first round. Rounds know records by their ids; the external ids of the last ones are looked up. A round is a semi-join of the edges with the records of the last one, an anti-join of
    the few sources found with all records reached, and one write, as one more partition of one table.
    """
    own = lambda df: df.select(_key("id", F.col("source")).alias("key")).where("key is not null")
    names = None if names is None else written(names, "aliases")

    def named(ids: DataFrame) -> DataFrame:
        """Records under all their keys; a key that several share is there for each."""
        return ids if names is None else ids.unionByName(names.join(ids, "key", "left_semi").select(F.col("alias").alias("key")))

    holders = own(edges.select("source").unionByName(faulty.select("source"))).distinct()
    useful = edges.join(spread(named(holders)), _PLACE, "left_semi").select(_key("id", F.col("source")).alias("record"), *_PLACE).where("record is not null")
    edges = lay(useful.distinct())
    reached = Growing(edges.sparkSession, "records", "key string", "level")
    n, level = reached.add(own(faulty).distinct(), 0), 0
    while n and (most_rounds is None or level < most_rounds):
        found = edges.join(spread(named(reached.part(level))), _PLACE, "left_semi").select(F.col("record").alias("key")).distinct()
        level += 1
        n = reached.add(found.join(reached.all().select("key"), "key", "left_anti"), level)
    records = reached.all()
    if names is None:
        return records
    shared = names.join(records, "key").groupBy(F.col("alias").alias("key")).agg(F.min("level").alias("level"))
    return records.unionByName(shared)


def direct_orphans(relations: DataFrame, entities: DataFrame, library: DataFrame) -> DataFrame:
    """(relation_id, source, key, seen_at) of the references whose target is not live when they were seen."""
    found = salted_join(references(relations), lives(entities, library), "key", "left_anti", _covers(), spread="relation_id")
    return found.dropDuplicates(["relation_id", "key", "seen_at"])


def reasons(orphans: DataFrame, entities: DataFrame, library: DataFrame) -> DataFrame:
    """``orphans`` with ``reason``: missing (no such target), deleted (all lives are over), later (none has begun) or between."""
    spans = lives(entities, library).groupBy("key").agg(F.min("begins").alias("first"), F.max(_end()).alias("last"))
    return salted_join(orphans, spans, "key", "left", spread="relation_id").withColumn("reason", _reason()).drop("first", "last")


def cascade(refs: DataFrame, direct: DataFrame, most_rounds: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """(relation_id, level): 0 for direct orphans, k for references to a record that is faulty by k steps.

    For references whose direct orphans are known already (``levels`` finds both): ``refs`` and ``direct`` have
    relation_id, source and key. ``names`` are the records' ``aliases``; without them no reference by an external id
    inherits a fault.
    """
    hot, n, buckets = hot_keys(refs, "key"), salts(refs.sparkSession), buckets_for(refs)
    every = all_salts("key", hot, n)
    spread = lambda df: df.withColumn("salt", F.explode(every))
    lay = lambda df: bucketed(df, "edges", _PLACE, buckets)
    faulty = written(direct.select("relation_id", "source"), "orphans")
    placed = refs.select("relation_id", "source", "key").withColumn("salt", salt_of("key", "relation_id", hot, n)).repartition(buckets, *_PLACE).distinct()
    rest = lay(placed.join(faulty.select("relation_id"), "relation_id", "left_anti"))
    records = fixpoint(faulty, rest, names, spread, lay, most_rounds)
    inherited = rest.join(spread(records), _PLACE).select("relation_id", F.col("level") + 1)
    found = faulty.select("relation_id", F.lit(0).alias("level")).union(inherited)
    if most_rounds is not None:
        found = found.where(F.col("level") <= most_rounds)
    return found.groupBy("relation_id").agg(F.min("level").alias("level"))


def levels(relations: DataFrame, entities: DataFrame, library: DataFrame) -> DataFrame:
    """(relation_id, level) of every orphaned reference: 0 if directly, k if its target is a record faulty by k steps."""
    found = Checked(relations, entities, library).levels().where("level is not null")
    return found.groupBy("relation_id").agg(F.min("level").alias("level"))


def level_counts(relations: DataFrame, entities: DataFrame, library: DataFrame) -> DataFrame:
    """(column_name, level, n): orphaned references by the column that names the target and by level."""
    found = Checked(relations, entities, library).levels().where("level is not null")
    return found.groupBy(_column().alias("column_name"), "level").agg(F.count("*").alias("n"))


def _column() -> Column:
    return F.when(F.col("key").startswith("id:"), "target_id").otherwise("target_ref")


def report(relations: DataFrame, entities: DataFrame, library: DataFrame, name: str = "code_relations") -> DataFrame:
    """References and orphans per table, column and month: direct ones by reason, and inherited ones."""
    every = Checked(relations, entities, library).levels()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return every.groupBy(F.lit(name).alias("table_name"), _column().alias("column_name"), F.date_format("seen_at", "yyyy-MM").alias("period")).agg(
        F.count("*").alias("n_references"),
        count(F.col("level") == 0).alias("n_direct"),
        *(count(F.coalesce(F.col("reason") == r, F.lit(False))).alias(f"n_{r}") for r in ("missing", "deleted", "later", "between")),
        count(F.col("level") > 0).alias("n_inherited"),
    )
