"""Stages, worksets, fitted pieces, contexts and artifacts on small fixtures, nulls and empty tables included."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_hierarchy import ROWS, table
from tests.test_whole import looped_rows
from vaultspark import session
from vaultspark.functions import md
from vaultspark.operators import hierarchy as H
from vaultspark.operators import layout, ordered, patch, rank, search, split, stages, workset
from vaultspark.operators import notes as N
from vaultspark.sources import artifacts


def test_walks_of_any_size_give_the_same_columns(spark):
    random.seed(3)
    rows = looped_rows() + [(i + 900, "big", f"s{i}", f"s{random.randint(0, i - 1)}" if i else None) for i in range(60)] + [(2000, "big", "lonely", "nowhere")]
    low, high = ({r.section_id: tuple(r) for r in H.hierarchy(table(spark, rows), max_group=m).select(*[c.split()[0] for c in H.WALKED.split(", ")]).collect()} for m in (5, 10_000))
    assert low == high and len(low) == len({r[0] for r in rows})
    bare, large = ({tuple(r) for r in H.hierarchy(table(spark, ROWS), paths=False, max_group=m).select("section_id", "root_id", "depth", "seq", "n_descendants").collect()} for m in (1, 100))
    assert bare == large


def test_sums_before_in_hot_groups(spark):
    rows = [(g, i, i % 7) for g, n in (("hot", 500), ("cold", 3), (None, 4)) for i in range(n)]
    want, at = {}, {}
    for g, i, v in rows:
        want[g, i] = at.get(g, 0)
        at[g] = at.get(g, 0) + v
    got = ordered.total_before(spark.createDataFrame(rows, "g string, i int, v bigint"), ["g"], ["i"], "v").collect()
    assert {(r.g, r.i): r.before for r in got} == want


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k, d: d)}))
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_fitted_pieces():
    assert split.fitted_pieces("") == []
    text = "preface " * 40 + "\nChapter 1: One\n" + "word " * 100 + "\nChapter 2: Two\nshort\nChapter 3. Three\n" + "word " * 100
    got = split.fitted_pieces(text)
    assert [(p[0], p[4], p[2], p[3]) for p in got] == [("technical", "preamble", 0, 1), ("technical", "chapter", 1, 3), ("technical", "chapter", 3, 7)]
    large = "第一章 甲\n" + "\n".join(f"# part {k}\n" + "字" * 3000 for k in range(4)) + "\n第二章 乙\n" + "字" * 300
    got = split.fitted_pieces(large)
    assert [p[4] for p in got] == ["chapter", "h1", "h1", "h1", "chapter"] or [p[4] for p in got] == ["chapter", "h1", "h1", "h1", "h1", "chapter"]
    assert [(p[2], p[3]) for p in got] == list(zip([0, *[p[3] for p in got[:-1]]], [p[3] for p in got]))
    plain = "line of text\n" * 1200
    assert [(p[0], p[2], p[3]) for p in split.fitted_pieces(plain)] == [("lines", 0, 500), ("lines", 500, 1000), ("lines", 1000, 1200)]


def test_custom_patterns_need_no_hash(spark):
    docs = spark.createDataFrame([(1, "x\nChapter 3 begins\n第一章 甲"), (2, None)], "doc_id bigint, text string")
    got = {(r.line, r.type, r.title) for r in split.boundaries(docs, "doc_id", "text", [(r"^Chapter \d+", "chapter"), (r"^第.+章", "han")]).collect()}
    assert got == {(1, "chapter", "Chapter 3 begins"), (2, "han", "第一章 甲")}


def test_context_of_damaged_places(spark):
    text = "12\n\nbefore\na  b  c\nd  e  f\ng  h  i\n\nafter\nlater"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    (r,) = layout.candidates(rows, "k", "t").filter("risk_type = 'table_fragment'").collect()
    assert (r.page_hint, list(r.context_before), list(r.context_after)) == ("12", ["before"], ["after"])
    assert layout.candidates(rows.limit(0), "k", "t").count() == 0


def test_patches_joined_and_rejected(spark):
    schema = "queue_pos bigint, patch_id string, candidate_id string, operation string, payload struct<replacement:string,content:string,code_language:string,header:array<string>,cell_rows:array<array<string>>,separator:string,noise_lines:array<string>>, confidence double, approved boolean, queued_at string"
    none = (None,) * 7
    rows = [
        (1, "a", "c", "join_lines", (*none[:5], "", None), 0.9, True, "d1"),
        (2, "b", "c", "replace_with_table", (None, None, None, ["x", None], [["1"]], None, None), 0.9, True, "d1"),
        (3, "c", "c", "drop_noise_lines", (*none[:6], ["y", None]), 0.9, True, "d2"),
        (4, "d", "c", "join_lines", none, 0.9, True, "d3"),
    ]
    found = spark.createDataFrame([("c",)], "candidate_id string")
    valid = patch.validated(spark.createDataFrame(rows, schema), found)
    assert {r.queue_pos for r in valid.filter(F.size("errors") > 0).collect()} == {2, 3}
    assert {(r.batch, r.accepted) for r in patch.batches(valid, F.col("queued_at")).collect()} == {("d1", False), ("d2", False), ("d3", True)}
    text = valid.withColumn("target_excerpt", F.lit(" one \n\ntwo")).select("queue_pos", patch.rendered().alias("r"))
    assert {r.queue_pos: r.r for r in text.collect() if r.queue_pos in (1, 4)} == {1: "onetwo", 4: "one two"}


def test_summaries_take_the_place_of_old_ones(spark):
    from vaultspark.operators import render

    pages = spark.createDataFrame([(1, "---\ntitle: x\nsummary: old\n---\n> [!TLDR] old\n> more\n\nbody"), (2, "no front")], "k int, t string")
    got = {r.k: (r.a, r.b) for r in pages.select("k", render.with_summary(F.col("t"), F.lit("new"), "callout").alias("a"), render.with_summary(F.col("t"), F.lit("new"), "field").alias("b")).collect()}
    assert got[1][0] == "---\ntitle: x\nsummary: old\n---\n> [!tldr]\n> new\n\n\nbody" and got[1][1].startswith('---\ntitle: x\nsummary: "new"\n---\n> [!TLDR]')
    assert got[2] == ("> [!tldr]\n> new\n\nno front", "no front")


def test_orphans_link_to_nothing(spark):
    rows = [(1, "a.md", ["b"]), (2, "b.md", None), (3, "c.md", []), (4, "d.md", [None])]
    notes = spark.createDataFrame(rows, "note_id bigint, path string, outbound_links array<string>").withColumn("note_type", F.lit(None).cast("string"))
    assert {r.note_id for r in N.orphan_notes(notes).collect()} == {3, 4}


def test_workset_of_a_source(spark):
    sources = spark.createDataFrame([("raw/sources/iron/one.md", "# Iron Gate\n\ntext\n\n## Hinges"), ("raw/sources/iron/two.md", None), (None, "x")], "source_path string, text string")
    pages = spark.createDataFrame([("wiki/summary/iron/one.md", "own"), ("wiki/summary/iron/z.md", "x"), ("wiki/concept/iron-gate.md", "iron gate"), ("wiki/a.md", "of HINGES"), ("wiki/index.md", "iron gate"), ("wiki/b.md", None), (None, "hinges")], "path string, text string")
    got = {(r.page, r.reason) for r in workset.pages_to_review(sources, pages, ["wiki/b.md"]).collect()}
    assert got == {("wiki/summary/iron/z.md", "category"), ("wiki/concept/iron-gate.md", "concept"), ("wiki/a.md", "term"), ("wiki/b.md", "recent")}
    (entry,) = workset.entries(sources).collect()
    assert entry.summary_page == "wiki/summary/iron/one.md" and "wiki/concept/hinges.md" in entry.concept_pages and entry.evidence.startswith("title: Iron Gate\nexcerpt: text")
    assert workset.pages_to_review(sources.limit(0), pages).count() == 0


def test_answers_leave_out_logs_and_their_own_notes(spark):
    rows = [(1, "wiki/a.md", "summary", "gate"), (2, "wiki/log.md", None, "gate"), (3, "wiki/q.md", "query-note", "gate"), (4, "wiki/h.md", "index", '---\ntype: index\nindex_kind: "query-history"\n---\ngate'), (5, None, None, "gate")]
    pages = spark.createDataFrame(rows, "doc_id bigint, path string, page_type string, text string")
    assert {r.doc_id for r in rank.corpus(pages).collect()} == {1, 5}


def test_search_in_blocks(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, None), (3, "")], "k int, t string")
    words = spark.createDataFrame([("ab",), ("bc",), ("x",), ("",), (None,), ("ab",)], "word string")
    for block in (1, 100):
        assert sorted(tuple(r) for r in search.occurrences(texts, "k", "t", words, block).collect()) == [(1, "ab"), (1, "bc")]
    assert search.occurrences(texts, "k", "t", words.limit(0)).count() == 0


def test_stages_with_nulls(spark):
    books = spark.createDataFrame([("a", None, "a.md", None, None, None, ["root/x", None]), ("b", "B", None, True, True, None, None), ("c", "C", "c.md", False, True, True, ["root/y"])], "book_slug string, book_title string, source_file string, tombstoned boolean, review_needed boolean, promotion_blocked boolean, root_notes array<string>").withColumn("qa_candidate_count", F.lit(None).cast("int"))
    assert {tuple(r) for r in stages.book_status(books).collect()} == {("ready", 1, 0), ("tombstoned", 1, 0), ("review", 1, 0)}
    assert {tuple(r) for r in stages.tombstones(books, spark.createDataFrame([("c.md",)], "source_file string")).collect()} == {("a", "a", 2)}
    there = spark.createDataFrame([("root/x",), ("root/x",)], "path string")
    assert [tuple(r) for r in stages.section_index(books, there).collect()] == [("root", 1, 1, "- [[root/x]]")] and stages.section_index(books, there.limit(0)).count() == 0
    filed = spark.createDataFrame([("s", 2, 20, "h"), ("s", 1, 10, "g"), ("t", 3, None, "i")], "slug string, note_id bigint, mtime bigint, content_hash string")
    assert {(r.slug, r.page, r.n, r.body) for r in stages.query_history(stages.query_versions(filed)).collect()} == {("s", 1, 2, "- [[s--v2|Version 2]]\n- [[s--v1|Version 1]]"), ("t", 1, 1, "- [[t--v1|Version 1]]")}
    converted = spark.createDataFrame([("a", "error"), ("b", "empty")], "path string, status string")
    assert not any(r.batch_ok for r in stages.conversion_tallies(converted).collect()) and stages.conversion_tallies(converted.limit(0)).count() == 0


def test_state_is_merged(spark, tmp_path):
    state = spark.createDataFrame([("a", "new", "r/a", "h", None, True, ["x"], None), ("b", "new", "r/b", "h", None, True, None, None)], artifacts.FILES)
    change = spark.createDataFrame([("a", "done", None, None, None, False, None, None), ("c", "new", None, None, None, None, None, None)], artifacts.FILES)
    merged = artifacts.merged_state(state, change, "2026-01-01 00:00:00")
    got = {r.source_key: (r.status, r.raw_path, r.dirty, r.updated_at is not None) for r in merged.collect()}
    assert got == {"a": ("done", "r/a", False, True), "b": ("new", "r/b", True, False), "c": ("new", None, None, True)}
    artifacts.write_artifact(merged, f"{tmp_path}/state")
    assert artifacts.read_artifact(spark, f"{tmp_path}/state", artifacts.FILES).count() >= 1
    (tmp_path / "one.json").write_text('[{"source_key": "k", "unknown": 1}]')
    assert [r.source_key for r in artifacts.read_artifact(spark, f"{tmp_path}/one.json", artifacts.FILES).collect()] == ["k"]


def test_names(spark):
    rows = spark.createDataFrame([(' 12 a/b: "c" ',), ("***",), ("",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(md.display_name(F.col("t")), md.section_name(F.col("t")), md.file_name(F.col("t"))).collect()]
    assert got == [("12 a-b- -c-", "a b c", "12-a_b-c_"), ("-", "Notes", "-"), ("untitled", "Notes", "untitled"), (None, None, None)]
