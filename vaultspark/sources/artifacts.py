"""Artifacts and state as JSON: lenient reads with a fixed schema, whole snapshots written, states merged row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of a state's rows; unknown fields of a file are dropped, missing ones are null.
FILES = "source_key string, status string, raw_path string, hash string, category string, dirty boolean, artifacts array<string>, updated_at timestamp"


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON artifact, an array or one object a file; what doesn't parse gives no row."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def write_artifact(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines below path, in place of what was there."""
    rows.write.mode("overwrite").json(path)


def merged_state(state: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """The state's rows (FILES) after changes of the same columns: a null in a change keeps what was there; changed rows are stamped `now`.

    Several changes of one key count by the greatest updated_at.
    """
    columns = [c for c in state.columns if c not in ("source_key", "updated_at")]
    last = changes.groupBy("source_key").agg(F.max_by(F.struct(*columns), F.coalesce("updated_at", F.lit(0).cast("timestamp"))).alias("c"))
    joined = state.join(last, "source_key", "full")
    stamp = F.when(F.col("c").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))
    return joined.select("source_key", *[F.coalesce(f"c.{c}", c).alias(c) for c in columns], stamp.alias("updated_at")).select(*state.columns)
