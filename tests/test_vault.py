import random

from pyspark.sql import functions as F

from vaultspark.operators import compile as C
from vaultspark.operators import notes as N
from vaultspark.operators import rank, scan, views
from vaultspark.operators.ordered import grouped_position, neighbours


def test_positions_in_a_hot_group(spark):
    random.seed(4)
    rows = [("hot" if random.random() < 0.7 else f"g{random.randint(0, 3)}", i) for i in random.sample(range(10_000), 2000)] + [(None, 1), (None, 2)]
    got = grouped_position(spark.createDataFrame(rows, "g string, x int"), ["g"], ["x"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r.position, r.x) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [x for _, x in mine] == sorted(x for _, x in mine)
    near = {(r.g, r.x): (r.previous, r.following) for r in neighbours(spark.createDataFrame(rows, "g string, x int").filter("g is not null"), "g", "x").collect()}
    hot = sorted(x for g, x in rows if g == "hot")
    assert near["hot", hot[0]] == (None, hot[1]) and near["hot", hot[5]] == (hot[4], hot[6])


def test_scan_prunes_folders_and_groups_names(spark):
    paths = ["a/b.md", "a/.venv/x.md", "node_modules/y.md", ".hid/z.md", "a/x.egg-info/k.TXT", "REG-001.pdf", "reg_002.pdf", "note one.md", "note two.md", "note-3.md", "c.xyz"]
    found = scan.files(spark.createDataFrame([(p, 60_000) for p in paths] + [(None, 1)], "path string, size bigint"))
    assert {r.path for r in found.collect()} == set(paths) - {"a/.venv/x.md", "node_modules/y.md", ".hid/z.md"}
    stats = {r.extension: r.n_files for r in scan.format_stats(found).collect()}
    assert stats == {".md": 4, ".txt": 1, ".pdf": 2, None: 7}
    assert {(r.kind, r.label, r.n) for r in scan.name_groups(found).collect()} == {("numbered_pattern", "REG-NNN", 2), ("common_prefix", "note", 3)}
    assert scan.language_bias(found).first().bias == "latin"
    assert scan.language_bias(spark.createDataFrame([("漢字漢字.md", 1)], "path string, size bigint").transform(scan.files)).first().bias == "cjk"


def test_title_mentions_in_blocks(spark):
    texts = spark.createDataFrame([(1, "about Iron Gate and [[Rose]] Rose"), (2, None), (3, "")], "k int, t string")
    titles = spark.createDataFrame([("Iron Gate",), ("Rose",), ("Gate",), ("ab",), ("Iron Gate",)], "title string")
    assert {(r.k, r.title) for r in N.title_mentions(texts, "k", "t", titles, block=2).collect()} == {(1, "Iron Gate"), (1, "Gate")}
    assert N.title_mentions(texts, "k", "t", titles.limit(0)).count() == 0


def test_ranking_against_brute_force(spark):
    random.seed(6)
    words = ["aa", "aaa", "bee", "seven", "x"]
    pages = [(i, " ".join(random.choices(words, k=8))) for i in range(60)] + [(99, None), (98, "")]
    asked = [(1, "aa Seven"), (2, "none of it"), (3, None), (4, "aa Seven")]
    got = rank.ranked(spark.createDataFrame(asked, "question_id bigint, question string"), spark.createDataFrame(pages, "doc_id bigint, text string"), 3).collect()
    for q, text in asked:
        tokens = {t for t in (text or "").lower().split() if len(t) > 1}
        scored = sorted(((-sum(p.count(t) for t in tokens), d) for d, p in pages if p), key=lambda x: x)
        assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r.place) if r.question_id == q] == [(d, -s) for s, d in scored if s < 0][:3]


def test_versions(spark):
    filed = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "slug string, hash string")
    latest = spark.createDataFrame([("a", 1, "h0"), ("a", 2, "h1"), ("b", 1, "h1")], "slug string, version int, hash string")
    assert {(r.slug, r.version, r.action) for r in rank.versioned(filed, latest).collect()} == {("a", 2, "merged"), ("b", 2, "versioned"), ("c", 1, "created")}


def test_incremental_delta_and_dirty(spark):
    s = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    got = {r.path: r.change for r in C.ingest_delta(s([("a", "1"), ("b", "1"), ("c", "1"), ("n", None)]), s([("a", "1"), ("b", "2"), ("d", "1"), ("n", None)])).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "removed", "d": "new", "n": "changed"}
    tracked = spark.createDataFrame([("a", "1", True), ("b", "1", True), ("c", "1", False)], "path string, hash string, has_summary boolean")
    assert {r.path for r in C.dirty(s([("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")]), tracked).collect()} == {"b", "c", "d"}


def test_promotion_plan_and_guard(spark):
    p = spark.createDataFrame([("t1", "me", "x"), ("t2", "me", "x"), ("t3", "me", "x"), ("t4", "me", "y")], "target string, owner string, content string")
    e = spark.createDataFrame([("t2", "other", "x"), ("t3", "me", "x"), ("t4", "me", "x"), ("t2", None, "x")], "target string, owner string, content string")
    assert {r.target: r.action for r in C.promotion_plan(p, e).collect()} == {"t1": "write", "t2": "conflict", "t3": "identical", "t4": "update"}
    paths = {"a/b": True, "../x": False, "a/../../x": False, "/a": False, "a/../b": True, "./a": True}
    rows = spark.createDataFrame([(k,) for k in paths], "p string").select("p", C.inside_root(F.col("p")).alias("ok")).collect()
    assert {r.p: r.ok for r in rows} == paths


def test_views(spark):
    rows = spark.createDataFrame([(1, "draft", "x"), (2, None, "y"), (3, "done", None)], "i int, s string, c string")
    spec = {"filter": {"or": [{"field": "s", "operator": "is-not", "value": "done"}, {"field": "c", "operator": "is-empty"}]}, "formulas": {"j": "i * 2"}, "sort": [["i", "desc"]], "limit": 2, "columns": ["i", "j"]}
    assert [tuple(r) for r in views.view(rows, spec).collect()] == [(3, 6), (2, 4)]
    got = {r.category: (r.draft, r.done, r.n, r.percent) for r in views.progress(rows.withColumnRenamed("c", "category"), "category", "s", ["draft", "done"]).collect()}
    assert got == {"x": (1, 0, 1, 0.0), "y": (0, 0, 1, 0.0), "none": (0, 1, 1, 100.0), "Total": (1, 1, 3, 33.3)}


def test_empty_vault(spark):
    import glob

    empty = spark.read.parquet(glob.glob("/root/testdata/sf0.001/vault_registry.parquet")[0]).limit(0)
    for f in (N.inbound, N.broken_links, N.orphan_notes, N.weak_notes, N.category_index, N.registry_notes, N.duplicate_concepts, C.concepts):
        assert f(empty).count() == 0
    assert N.registry_stats(empty).first().n_notes == 0
