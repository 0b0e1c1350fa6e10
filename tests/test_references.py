from datetime import datetime as D

from vaultspark.operators import references as R

NOTES = "note_id bigint, path string, outbound_links array<string>, source_path string, page_sources array<string>, mtime timestamp_ntz, removed_at timestamp_ntz, kind string, reason string"
RAWS = "path string, ingested_at timestamp_ntz, removed_at timestamp_ntz, ref_key string"
T = lambda m, d=1: D(2024, m, d)


def found(spark, notes, raws=()):
    rows = R.find_orphans(spark.createDataFrame(list(notes), NOTES), spark.createDataFrame(list(raws), RAWS)).collect()
    return sorted((r.note_id, r.field_name, r.target_ref, r.reason, r.period) for r in rows)


def note(i, path, links=None, source=None, pages=None, at=T(5), gone=None):
    return (i, path, links, source, pages, at, gone, "x", "y")


def test_reasons_and_periods(spark):
    notes = [
        note(1, "a/one.md", [" two#Part", "b/three|x", "nowhere", "nowhere", None], "raw/a", ["raw/b", None]),
        note(2, "a/two.md", at=T(6)),  # begins after note 1
        note(3, "b/three.md", at=T(1), gone=T(2)),
        note(4, "b/three.md", at=T(3), gone=T(5)),  # ends just when note 1 is written
    ]
    raws = [("raw/a", T(1), T(4), ""), ("raw/a", T(4, 15), None, ""), ("raw/b", T(1), T(4), "")]
    assert found(spark, notes, raws) == [
        (1, "outbound_links", " two#Part", "late", "2024-05"),
        (1, "outbound_links", "b/three|x", "deleted", "2024-05"),
        (1, "outbound_links", "nowhere", "missing", "2024-05"),
        (1, "page_sources", "raw/b", "deleted", "2024-05"),
    ]


def test_nulls_repeats_and_empty_tables(spark):
    assert found(spark, []) == []
    twice = [note(1, None, None, "gone", None), note(1, None, None, "gone", None)]
    assert found(spark, twice) == [(1, "source_path", "gone", "missing", "2024-05")]
    unknown = [note(1, "a/x.md", ["y", "z"], at=None), note(2, "a/y.md")]
    assert found(spark, unknown) == [(1, "outbound_links", "z", "missing", None)]


def test_covered_by_an_earlier_month(spark):
    """The running maximum carries over months, and over a period nested in another."""
    raws = [("r", T(1), T(9), ""), ("r", T(2), T(3), "")]
    notes = [note(i, f"n{i}.md", None, "r", None, at=T(i)) for i in range(1, 13)]
    assert [n for n, *_ in found(spark, notes, raws)] == [9, 10, 11, 12]


def test_hot_key_against_brute_force(spark):
    import random

    random.seed(3)
    raws = [("hot", T(random.randint(1, 12), random.randint(1, 28)), None, "") for _ in range(40)]
    raws = [(p, b, D(2024, min(12, b.month), 28) if b.day < 28 else None, k) for p, b, _, k in raws]
    raws = [r for r in raws if r[2]]
    notes = [note(i, f"n{i}.md", None, "hot", None, at=T(random.randint(1, 12), random.randint(1, 28))) for i in range(300)]
    expected = {i for i, _, _, _, _, at, *_ in notes if not any(b <= at < e for _, b, e, _ in raws)}
    assert {n for n, *_ in found(spark, notes, raws)} == expected


def test_report_counts_every_reference(spark):
    notes = spark.createDataFrame([note(1, "a.md", ["b", "c"]), note(2, "b.md", at=T(1))], NOTES)
    row = R.orphan_report(notes, spark.createDataFrame([], RAWS)).collect()
    assert [(r.field_name, r.period, r.n_refs, r.n_missing, r.n_late, r.n_deleted) for r in row] == [("outbound_links", "2024-05", 2, 1, 0, 0)]
