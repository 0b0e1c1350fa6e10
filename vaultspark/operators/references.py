"""References to records that do not exist (p4).

Distinct foreign keys are left-anti-joined against the parent keys that hold for good; only the suspects that remain are joined
back to their rows, where each reference gets its reason. Parents with an end are tested by a running maximum over ranges of time,
never by pairing references with intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.session import stage_table

NEVER = "9999-12-31 00:00:00"
#: Unicode white space, as trimmed from a link's name.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def note_stem(path: Column) -> Column:
    """Last part of a path without `.md`."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")


def link_name(link: Column) -> Column:
    """The note that a link names: the last part of what stands before any | and #, trimmed."""
    name = F.substring_index(F.substring_index(F.substring_index(link, "|", 1), "#", 1), "/", -1)
    return F.regexp_replace(name, f"^{SPACE}+|{SPACE}+$", "")


def note_references(notes: DataFrame) -> DataFrame:
    """note_id, at, field_name, target_ref, kind, ref_key: one row for each distinct non-null entry of a note's three fields."""
    entries = F.explode(
        F.array_distinct(
            F.concat(
                F.transform(F.coalesce("outbound_links", F.array().cast("array<string>")), lambda x: F.struct(F.lit("outbound_links").alias("field_name"), x.alias("target_ref"))),
                F.array(F.struct(F.lit("source_path").alias("field_name"), F.col("source_path").alias("target_ref"))),
                F.transform(F.coalesce("page_sources", F.array().cast("array<string>")), lambda x: F.struct(F.lit("page_sources").alias("field_name"), x.alias("target_ref"))),
            )
        )
    ).alias("entry")
    is_link = F.col("field_name") == "outbound_links"
    return (
        notes.select("note_id", F.col("mtime").alias("at"), entries)
        .select("note_id", "at", "entry.field_name", "entry.target_ref")
        .filter(F.col("target_ref").isNotNull())
        .withColumn("kind", F.when(is_link, "note").otherwise("raw"))
        .withColumn("ref_key", F.when(is_link, link_name(F.col("target_ref"))).otherwise(F.col("target_ref")))
    )


def parent_periods(notes: DataFrame, raws: DataFrame) -> DataFrame:
    """kind, ref_key, begins, ends (null = still there): when each possible target existed. A null beginning never comes."""

    def of(rows: DataFrame, kind: str, key: Column, begin: str) -> DataFrame:
        never = F.lit(NEVER).cast("timestamp_ntz")
        return rows.filter(key.isNotNull()).select(
            F.lit(kind).alias("kind"),
            key.alias("ref_key"),
            F.coalesce(F.col(begin).cast("timestamp_ntz"), never).alias("begins"),
            F.col("removed_at").cast("timestamp_ntz").alias("ends"),
        )

    return of(notes, "note", note_stem(F.col("path")), "mtime").unionByName(of(raws, "raw", F.col("path"), "ingested_at"))


def orphan_references(refs: DataFrame, periods: DataFrame) -> DataFrame:
    """The rows of refs (note_id, at, field_name, target_ref, kind, ref_key) without a target at that time, with their reason.

    missing = no such parent at all; late = parents exist but all begin after `at`; deleted = some began by then, none still
    existed. A reference of unknown time (`at` null) can only be missing. Repeated rows give one row.
    """
    key = ["kind", "ref_key"]
    refs = refs.withColumn("at", F.col("at").cast("timestamp_ntz"))
    facts = periods.groupBy(*key).agg(F.min("begins").alias("first"), F.min(F.when(F.col("ends").isNull(), F.col("begins"))).alias("open_from"))
    wanted = refs.groupBy(*key).agg(F.min("at").alias("earliest"))
    solid = facts.filter(F.col("open_from").isNotNull()).select(*[F.col(k).alias(f"solid_{k}") for k in key], "open_from")
    suspects = wanted.join(
        solid,
        (F.col("kind") == F.col("solid_kind")) & (F.col("ref_key") == F.col("solid_ref_key")) & ((F.col("open_from") <= F.col("earliest")) | F.col("earliest").isNull()),
        "left_anti",
    ).select(*key)
    suspects = stage_table(suspects.join(facts, key, "left"))
    judged = refs.join(suspects, key).withColumn(
        "reason",
        F.when(F.col("first").isNull(), "missing")
        .when(F.col("at").isNull(), None)
        .when(F.col("first") > F.col("at"), "late")
        .when(F.col("open_from") <= F.col("at"), None)
        .otherwise("unsettled"),
    ).filter(F.col("reason").isNotNull())
    judged = stage_table(judged)
    columns = ["note_id", "at", "field_name", "target_ref", *key, "reason"]
    closed = periods.filter(F.col("ends") > F.col("begins")).join(suspects.filter(F.col("first").isNotNull()).select(*key), key, "left_semi")
    gone = _not_covered(judged.filter("reason = 'unsettled'").select(*columns[:-1]), closed).withColumn("reason", F.lit("deleted"))
    out = judged.filter("reason <> 'unsettled'").select(*columns).unionByName(gone.select(*columns))
    return out.dropDuplicates(["note_id", "field_name", "target_ref", "at"])


def _not_covered(refs: DataFrame, periods: DataFrame) -> DataFrame:
    """refs whose `at` lies in none of the periods of their key.

    A time is covered if the latest end among the periods begun by then lies after it. Each distinct time of a key is judged once.
    Times and periods are range-partitioned by key and time, so a hot key, or a hot month of it, spans many ranges; the running
    maximum is taken within a range and carried over from the ranges before. Equal times of a key never part.
    """
    key = ["kind", "ref_key"]
    times = refs.select(*key, F.col("at").alias("time")).distinct().withColumns({"end": F.lit(None).cast("timestamp_ntz"), "asked": F.lit(True)})
    events = times.unionByName(periods.select(*key, F.col("begins").alias("time"), F.col("ends").alias("end"), F.lit(False).alias("asked")))
    ranged = stage_table(events.repartitionByRange(*key, "time").withColumn("range", F.spark_partition_id()))
    earlier = F.max("range_end").over(Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = ranged.groupBy(*key, "range").agg(F.max("end").alias("range_end")).withColumn("carry", earlier).select(*key, "range", "carry")
    within = Window.partitionBy(*key, "range").orderBy("time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    latest = ranged.withColumn("met", F.max("end").over(within)).join(carried, [*key, "range"])
    open_ = latest.filter(F.col("asked") & ~F.coalesce(F.greatest("carry", "met") > F.col("time"), F.lit(False))).select(*key, F.col("time").alias("at"))
    return refs.join(open_, [*key, "at"]).select(*refs.columns)


def find_orphans(notes: DataFrame, raws: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """note_id, field_name, target_ref, reason, period (YYYY-MM of mtime, null where that is unknown) of every orphan reference.

    The references are read from the notes once and staged; refs are those of the same notes, where they are staged already.
    """
    refs = stage_table(note_references(notes)) if refs is None else refs
    found = orphan_references(refs, parent_periods(notes, raws))
    return found.select("note_id", "field_name", "target_ref", "reason", F.date_format("at", "yyyy-MM").alias("period"))


def orphan_report(notes: DataFrame, raws: DataFrame) -> DataFrame:
    """Per field and period: entries, and orphans by reason. Every period with entries has a row."""
    refs = stage_table(note_references(notes))
    totals = refs.groupBy("field_name", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n_refs"))
    reasons = ["missing", "late", "deleted"]
    orphans = find_orphans(notes, raws, refs).groupBy("field_name", "period").agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in reasons])
    joined = totals.alias("t").join(orphans.alias("o"), (F.col("t.field_name") == F.col("o.field_name")) & F.col("t.period").eqNullSafe(F.col("o.period")), "left")
    return joined.select("t.field_name", "t.period", "n_refs", *[F.coalesce(f"n_{r}", F.lit(0)).alias(f"n_{r}") for r in reasons])
