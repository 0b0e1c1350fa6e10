"""Duplicates hidden by formatting differences (p3).

Each record's fields are brought to one form, sorted and hashed to 128 bits; copies are counted with map-side combining. A second
hash and the length, held as minimum and maximum of each group, show collisions, whose rows are grouped by the full form instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.session import stage_table


def canonical_fields(text: Column) -> Column:
    """`name:value` of each line, without letter case and characters that are neither letters nor digits, in sorted order.

    A line's first colon ends its name. Lines of which nothing is left are dropped.
    """
    kept = F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}:\r\n]+", "")))
    name = lambda line: F.substring_index(line, ":", 1)
    plain = F.transform(F.split(kept, r"\r\n|\n|\r"), lambda line: F.concat(name(line), F.lit(":"), F.replace(F.substr(line, F.length(name(line)) + 1), F.lit(":"), F.lit(""))))
    return F.array_join(F.array_sort(F.filter(plain, lambda line: line != ":")), "\n")


def hashed(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, key (128 bits), check, size of every row with a text."""
    form = F.col("form")
    return (
        rows.filter(F.col(text_column).isNotNull())
        .select(F.col(id_column).alias("id"), canonical_fields(F.col(text_column)).alias("form"))
        .select("id", F.unhex(F.md5(form)).alias("key"), F.xxhash64(form).alias("check"), F.length(form).alias("size"))
    )


def groups(rows: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(members: id, key), (records: key, first_id, n_copies). Rows with a null text are left out; a repeated id counts each time."""
    members = stage_table(hashed(rows, id_column, text_column))
    records = members.groupBy("key").agg(
        F.min("id").alias("first_id"), F.count("*").alias("n_copies"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("size").alias("s0"), F.max("size").alias("s1")
    )
    clash = records.filter("c0 <> c1 or s0 <> s1").select("key")
    if clash.limit(1).count():
        clash = stage_table(clash)
        form = canonical_fields(F.col(text_column))
        again = rows.filter(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), form.alias("form")).withColumn("key", F.unhex(F.md5("form"))).join(clash, "key", "left_semi")
        again = again.select("id", F.encode("form", "UTF-8").alias("key"))  # never 16 bytes of a digest and a form at once: forms hold a colon
        members = stage_table(members.join(clash, "key", "left_anti").select("id", "key").unionByName(again))
        records = members.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies"))
    return members.select("id", "key"), records.select("key", "first_id", "n_copies")


def copies(rows: DataFrame, id_column: str = "note_id", text_column: str = "frontmatter") -> DataFrame:
    """first_id, copy_id: one row for each row of a group besides its smallest id. Adaptive joins split a hot group, whose own side is one row."""
    members, records = groups(rows, id_column, text_column)
    several = records.filter("n_copies > 1").select("key", "first_id")
    return members.join(several, "key").filter("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()


def collapsed(rows: DataFrame, id_column: str = "note_id", text_column: str = "frontmatter") -> DataFrame:
    """first_id, n_copies of every distinct record."""
    return groups(rows, id_column, text_column)[1].select("first_id", "n_copies")
