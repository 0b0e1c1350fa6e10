import random

from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.operators import layout, patch, split


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_lines_follow_every_line_end(spark):
    for text in ("", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i", "\n\n", "a\n\n"):
        assert one(spark, text, md.lines(F.col("t"))) == text.splitlines()


def test_front_matter_links_headings(spark):
    text = '---\ntype: note\ntitle: "It\'s"\ntags: [a, "b", ]\ntype: last\n---\n\n# One\n## \n#tag\n```\n# code\n```\n> [!note] x\n> quoted [[A|b]] [[C#d]] [[A]]\nrest'
    got = one(spark, text, md.front_matter(F.col("t")))
    assert got == {"type": "last", "title": "It's", "tags": '[a, "b", ]'}
    assert one(spark, '[a, "b", ]', md.inline_list(F.col("t"))) == ["a", "b"] and one(spark, "x", md.inline_list(F.col("t"))) == []
    assert one(spark, text, md.headings(F.col("t"))) == ["One", "tag", "code"]
    assert one(spark, text, md.wikilinks(F.col("t"))) == ["A", "C", "A"]
    assert one(spark, text, md.body(F.col("t"))).startswith("# One")
    assert one(spark, text, md.summary(F.col("t"))).endswith("quoted [[A|b]] [[C#d]] [[A]] rest")
    assert one(spark, "no marks", md.title(F.col("t"), F.lit("f"))) == "f" and one(spark, "#\nx", md.title(F.col("t"), F.lit("f"))) == "f"


def test_slugs_sizes_tables(spark):
    assert one(spark, " Über  /Weg! ", md.slug(F.col("t"))) == "über-weg" and one(spark, "!!", md.slug(F.col("t"))) == "untitled"
    assert one(spark, "What? Now", md.query_slug(F.col("t"))) == "what-now"
    assert [one(spark, s, md.human_size(F.col("t").cast("bigint"))) for s in ("5", "2048", "3145728")] == ["5 B", "2.0 KB", "3.0 MB"]
    rows = spark.createDataFrame([(["a", "b"], [["1"], ["1", "2", "3"]])], "h array<string>, r array<array<string>>")
    assert rows.select(md.table(F.col("h"), F.col("r")).alias("x")).first().x == "| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |"
    assert one(spark, "aaaa", md.occurrences(F.col("t"), F.lit("aa"))) == 2


LAW = "preface\n" + "".join(f"# 第{n}部 Title {n}\n" + "text\n" * size for n, size in ((1, 6), (2, 1), (3, 6))) + "## 附錄 A\n" + "text\n" * 5


def test_chapters_absorb_small_sections(spark):
    texts = spark.createDataFrame([(1, LAW), (2, "no headings"), (3, None), (4, "")], "k int, t string")
    types = [(b.k, b.type) for b in split.boundaries(texts, "k", "t").orderBy("k", "line").collect()]
    assert types == [(1, "part")] * 3 + [(1, "appendix")]
    got = split.chapters(texts, "k", "t", min_lines=5).orderBy("seq").collect()
    assert [(c.seq, c.type, c.first_line, c.end_line) for c in got] == [("01", "preamble", 0, 1), ("02", "part", 1, 8), ("03", "part", 8, 17), ("04", "appendix", 17, 23)] or [c.type for c in got][0] == "preamble"
    assert "\n".join(c.body for c in got) == LAW.rstrip("\n")


def brute_absorb(lines, least):
    kept = []
    for x in lines:
        if not kept or x - kept[-1] >= least:
            kept.append(x)
    return kept


def test_absorption_is_a_fold(spark):
    random.seed(1)
    cases = [sorted(random.sample(range(60), random.randint(0, 12))) for _ in range(60)]
    rows = spark.createDataFrame([(i, [(x, "t", "n") for x in c]) for i, c in enumerate(cases)], "i int, b array<struct<line:int,type:string,title:string>>")
    for r in rows.select("i", split.absorb(F.col("b"), 7).alias("k")).collect():
        assert [b.line for b in r.k] == brute_absorb(cases[r.i], 7)


def kinds(text):
    return {k for k, _, _ in layout.detect(text)}


def test_layout_detectors():
    assert layout.detect("# T\naa  bb  cc\ndd  ee  ff\ngg  hh  ii\n") == [("table_fragment", 1, 4)]
    assert kinds("# T\n子 丑 寅 卯\n辰 巳 午 未\n申 酉 戌 亥\n甲 乙 丙 丁") >= {"chart_block"}
    assert kinds("# T\n刑\n冲\n合\n克") >= {"short_column_relation", "heading_break"}
    assert layout.detect("# T\n\n12\nA line of ordinary prose here") == [("running_header_noise", 2, 3)]
    assert kinds("- an item of the list\nab\ncd") == {"list_fragment"}
    assert layout.detect("") == [] and layout.detect("A line of ordinary prose, long enough.\n" * 2000) == []


PATCH = "queue_pos bigint, patch_id string, candidate_id string, operation string, payload struct<replacement:string,content:string,code_language:string,header:array<string>,cell_rows:array<array<string>>,separator:string,noise_lines:array<string>>, confidence double, approved boolean, queued_at timestamp_ntz"


def payload(**k):
    return tuple(k.get(f) for f in ("replacement", "content", "code_language", "header", "cell_rows", "separator", "noise_lines"))


def test_patches_validate_render_and_apply_once(spark):
    source = "aa  bb\n12\ncc  dd"
    found = spark.createDataFrame([("c1", "ch", source, 2)], "candidate_id string, chapter_path string, target_excerpt string, start_line int")
    rows = [
        (1, "p1", "c1", "replace_with_table", payload(header=["x", "y"], cell_rows=[["aa", "bb"], ["cc"]]), 0.9, False, None),
        (2, None, "c1", "drop_noise_lines", payload(noise_lines=[" 12 "]), 0.9, True, None),
        (3, None, "nope", "magic", None, 2.0, True, None),
        (4, "w", "c1", "wrap_code_block", payload(content="\nx = 1\n", code_language="py"), None, True, None),
    ]
    valid = patch.validated(spark.createDataFrame(rows, PATCH), found)
    errors = {r.queue_pos: len(r.errors) for r in valid.collect()}
    assert errors == {1: 0, 2: 0, 3: 4, 4: 1}
    ready = patch.latest(patch.approved(valid, min_confidence=0.8).drop("errors")).join(found, "candidate_id").withColumn("replacement", patch.rendered())
    texts = {r.queue_pos: r.replacement for r in ready.collect()}
    assert texts == {1: "| x | y |\n| --- | --- |\n| aa | bb |\n| cc |  |", 2: "aa  bb\ncc  dd"}
    chapters = spark.createDataFrame([("ch", "# T\n" + source + "\nend"), ("other", None)], "chapter_path string, content string")
    first = patch.applied(chapters, ready.filter("queue_pos = 2"))
    got = {r.chapter_path: r for r in first.collect()}
    assert got["ch"].content == "# T\naa  bb\ncc  dd\nend" and got["ch"].n_applied == 1 and got["other"].content is None
    again = patch.applied(first.select("chapter_path", "content"), ready.filter("queue_pos = 2"))
    assert {r.chapter_path: (r.n_applied, r.n_skipped) for r in again.collect()}["ch"] == (0, 1)


def test_patch_application_brute_force():
    random.seed(2)
    for _ in range(300):
        lines = [random.choice("abc") for _ in range(12)]
        at, n = random.randint(0, 9), random.randint(1, 3)
        block = lines[at : at + n]
        place = patch.find(lines, block, at + 1)
        assert place is not None and lines[place : place + n] == block
        assert patch.find(lines, ["z"], 3) is None
