from datetime import datetime as D

from vaultspark.operators import scan
from vaultspark.sources import vaultfiles as V
from vaultspark.streaming import ingest


def test_read_write_and_marked_pages(spark, tmp_path):
    pages = spark.createDataFrame([("a/x.md", "# X\n"), ("_c MOC.md", "moc"), ("../out.md", "no"), ("n.md", None)], "path string, content string")
    root = str(tmp_path)
    assert {(r.path, r.action) for r in V.write_pages(pages, root).collect()} == {("a/x.md", "written"), ("_c MOC.md", "written"), ("../out.md", "refused")}
    assert {r.action for r in V.write_pages(pages, root).collect()} == {"identical", "refused"}
    (tmp_path / "bad.md").write_bytes(b"a\xffb")
    got = {r.path: r.content for r in V.read_pages(spark, root).collect()}
    assert got == {"a/x.md": "# X\n", "bad.md": "a�b"}
    assert [r.content for r in V.read_marked_pages(spark, root).collect()] == ["moc"]
    assert scan.format_stats(scan.files(V.file_table(spark, root))).filter("extension = '.md'").first().n_files == 3


def test_conversion(spark):
    html = "<h1>T</h1><script>x</script><p>a <b>b</b> <a href='u'>c</a></p><ul><li>i</li></ul><table><tr><th>h</th><th>k</th></tr><tr><td>1</td></tr></table>"
    rows = [("x.html", html), ("x.csv", "a,b\n1\n"), ("x.pdf", "?"), ("x.xyz", "?"), ("x.md", ""), (None, "x"), ("x.TXT", "t")]
    got = {r.path: (r.status, r.markdown) for r in V.convert(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["x.html"] == ("converted", "# T\n\na **b** [c](u)\n\n- i\n\n| h | k |\n| --- | --- |\n| 1 |  |")
    assert got["x.csv"][1] == "| a | b |\n| --- | --- |\n| 1 |  |" and got["x.TXT"] == ("converted", "t")
    assert (got["x.pdf"][0], got["x.xyz"][0], got["x.md"][0]) == ("needs_provider", "unsupported", "empty")
    parts = spark.createDataFrame([("b", 2, "p/two.md", "text"), ("b", 1, "p/one.md", "# One\nx"), ("b", 3, "q", None)], "book string, ord int, path string, markdown string")
    book = V.combine(parts).first()
    assert book.title == "One" and book.text == "# One\n\nSource file: p/one.md\n\n# One\nx\n\n# two\n\nSource file: p/two.md\n\ntext"


def test_streams(spark, tmp_path):
    t = D(2024, 1, 1)
    spark.createDataFrame([("a", "# A", t), ("a", "# A", t), ("b", "b", t), (None, "x", t)], ingest.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("a", "# A", t), ("b", "changed", D(2024, 1, 1, 1))], ingest.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = sorted((r.path, r.content, r.title) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "# A", "A"), ("b", "b", "b"), ("b", "changed", "b")]
    stream = spark.readStream.schema(ingest.SCHEMA).parquet(str(tmp_path / "in"))
    ingest.upsert_stream(stream, str(tmp_path / "snap"), str(tmp_path / "cp2")).awaitTermination()
    assert {r.path: r.content for r in spark.read.parquet(str(tmp_path / "snap/v0")).filter("path is not null").collect()} == {"a": "# A", "b": "changed"}


def test_activity_windows(spark):
    rows = spark.createDataFrame([(D(2024, 1, 1, 0, m), "x") for m in (1, 30, 59)] + [(D(2024, 1, 1, 1), "x")], "ts timestamp, event_type string")
    assert {(r.window_start.hour, r.n) for r in ingest.activity(rows).collect()} == {(0, 3), (1, 1)}
