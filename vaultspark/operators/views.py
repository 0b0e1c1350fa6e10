"""Table views given as data: nested filters, sort keys, groups and computed columns, compiled to columns."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TESTS = {
    "is": lambda c, v: c == v,
    "is-not": lambda c, v: ~F.coalesce(c == v, F.lit(False)),
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "does-not-contain": lambda c, v: ~F.coalesce(F.contains(c, F.lit(v)), F.lit(False)),
    "starts-with": lambda c, v: F.startswith(c, F.lit(v)),
    "ends-with": lambda c, v: F.endswith(c, F.lit(v)),
    "is-empty": lambda c, v: F.coalesce(c.cast("string"), F.lit("")) == "",
    "is-not-empty": lambda c, v: F.coalesce(c.cast("string"), F.lit("")) != "",
    "is-greater-than": lambda c, v: c > v,
    "is-less-than": lambda c, v: c < v,
    "in": lambda c, v: c.isin(v),
    "not_in": lambda c, v: ~F.coalesce(c.isin(v), F.lit(False)),
}


def condition(spec: dict[str, Any]) -> Column:
    """A filter tree: {"and": [...]}, {"or": [...]} or {"field", "operator", "value"}; a null field fails every test but the negative ones."""
    for word, join in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if word in spec:
            return reduce(join, [condition(s) for s in spec[word]])
    return F.coalesce(_TESTS[spec["operator"]](F.col(spec["field"]), spec.get("value")), F.lit(False))


def view(rows: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """rows under a spec of `filter`, `formulas` (name to SQL expression), `columns`, `sort` ([field, direction]) and `limit`."""
    out = rows.filter(condition(spec["filter"])) if spec.get("filter") else rows
    for name, text in spec.get("formulas", {}).items():
        out = out.withColumn(name, F.expr(text))
    if spec.get("sort"):
        out = out.orderBy(*[F.col(f).desc_nulls_last() if way == "desc" else F.col(f).asc_nulls_last() for f, way in spec["sort"]])
    if spec.get("limit"):
        out = out.limit(spec["limit"])
    return out.select(*spec["columns"]) if spec.get("columns") else out


def groups(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, n, place: counts of each group, those of `order` first."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]).cast("array<string>"), F.col(by))
    return rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))


def progress(rows: DataFrame, category: str, status: str, values: list[str]) -> DataFrame:
    """category (Total for all), one count for each status, n and the percentage of the last status."""
    keyed = rows.withColumnRenamed(category, "_c")
    named = F.when(F.grouping("_c") == 1, "Total").otherwise(F.coalesce("_c", F.lit("none"))).alias("category")
    counts = [F.count_if(F.col(status) == v).alias(v.replace("-", "_")) for v in values]
    done = F.round(100 * F.count_if(F.col(status) == values[-1]) / F.count("*"), 1).alias("percent")
    return keyed.rollup("_c").agg(named, *counts, F.count("*").alias("n"), done).drop("_c")
