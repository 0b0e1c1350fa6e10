from datetime import datetime as D

from pyspark.sql import functions as F

from vaultspark.operators import render


def one(spark, text, column):
    return spark.createDataFrame([(text, 'a "b"\nc', None)], "t string, s string, e string").select(column.alias("x")).first().x


def test_summary_modes(spark):
    t, s = F.col("t"), F.col("s")
    page = "---\ntype: x\n---\nbody"
    assert one(spark, page, render.with_summary(t, s)) == '---\ntype: x\n---\n> [!tldr]\n> a "b"\n> c\n\nbody'
    first = one(spark, page, render.with_summary(t, s, "field"))
    assert first == '---\ntype: x\nsummary: "a \\"b\\" c"\n---\nbody'
    assert one(spark, first, render.with_summary(t, s, "field")) == first
    assert one(spark, "body", render.with_summary(t, s, "field")) == "body"
    other = "---\nbook_summary: keep\nsummary: old\n---\nx"
    assert one(spark, other, render.with_summary(t, F.lit("new $1"), "field")) == '---\nbook_summary: keep\nsummary: "new $1"\n---\nx'
    assert one(spark, page, render.with_summary(t, F.col("e"))) == page


def test_fields_need_front_matter(spark):
    add = render.with_fields(F.col("t"), [("k", F.col("s")), ("n", F.col("e"))])
    assert one(spark, "---\na: 1\n---\nx", add) == '---\na: 1\nk: "a \\"b\\"\nc"\nn: ""\n---\nx' and one(spark, "x", add) == "x"


def test_links_are_added_once(spark):
    pages = spark.createDataFrame([("a", "text [[b]]"), ("z", "alone")], "stem string, content string")
    edges = spark.createDataFrame([("a", "b", "next"), ("a", "c", "next"), ("a", "c", "parent"), ("a", "d", "semantic"), ("a", "a", "next"), ("a", None, "next")], "src string, dst string, kind string")
    first = render.with_links(pages, edges)
    got = {r.stem: (r.content, r.n_added) for r in first.collect()}
    assert got == {"a": ("text [[b]]\n\n## Navigation\n\n- Next: [[c]]\n\n## Related\n\n- [[d]]", 2), "z": ("alone", 0)}
    assert {r.n_added for r in render.with_links(first.drop("n_added"), edges).collect()} == {0}


def test_log_entry(spark):
    rows = spark.createDataFrame([(D(2024, 1, 2, 3, 4), ["x", "y"]), (D(2024, 1, 2), [])], "t timestamp_ntz, d array<string>")
    got = [r.x for r in rows.select(render.log_entry(F.col("t"), F.lit("op"), F.lit("title"), F.col("d")).alias("x")).collect()]
    assert got == ["## [2024-01-02 03:04] op | title\n- x\n- y\n", "## [2024-01-02 00:00] op | title\n"]
