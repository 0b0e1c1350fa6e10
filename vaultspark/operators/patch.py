"""Proposed repairs of damaged places: validation, approval, merge of overrides and application to chapter lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import md

# Fixed values.
OPERATIONS = ["replace_block", "wrap_code_block", "replace_with_table", "join_lines", "drop_noise_lines"]
REACH = 8


def validated(patches: DataFrame, candidates: DataFrame) -> DataFrame:
    """The patches with `errors` (empty = valid). Candidates are looked up by distinct ids, unknown ids being an error."""
    known = candidates.select("candidate_id").distinct().withColumn("_known", F.lit(True))
    p, op = F.col("payload"), F.col("operation")
    holed = lambda items: F.coalesce(F.exists(items, lambda x: x.isNull()), F.lit(False))
    missing = F.coalesce(F.col("candidate_id"), F.lit("")) == ""
    errors = F.array_compact(
        F.array(
            F.when(missing, "no candidate is named"),
            F.when(~F.coalesce(op.isin(OPERATIONS), F.lit(False)), F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("null")))),
            F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence is not within 0 and 1"),
            F.when(p.isNull(), "no payload"),
            F.when(~missing & F.col("_known").isNull(), "candidate is unknown"),
            F.when((op == "replace_block") & p["replacement"].isNull(), "replacement is missing"),
            F.when((op == "wrap_code_block") & p["content"].isNull(), "content is missing"),
            F.when((op == "replace_with_table") & ((F.coalesce(F.size(p["header"]), F.lit(-1)) < 1) | holed(p["header"])), "header is missing or has a null cell"),
            F.when((op == "replace_with_table") & (p["cell_rows"].isNull() | holed(p["cell_rows"])), "rows are missing or one is null"),
            F.when((op == "drop_noise_lines") & holed(p["noise_lines"]), "a noise line is null"),
        )
    )
    return patches.join(known, "candidate_id", "left").withColumn("errors", errors).drop("_known")


def patch_key() -> Column:
    """patch_id, or candidate and operation where it is null or empty."""
    return F.coalesce(F.nullif(F.col("patch_id"), F.lit("")), F.concat_ws(":", "candidate_id", "operation"))


def approved(valid: DataFrame, approve_all: bool = False, min_confidence: float | None = None) -> DataFrame:
    """Valid patches that were approved, or reach min_confidence, or all of them."""
    ok = F.lit(approve_all) | F.coalesce("approved", F.lit(False))
    if min_confidence is not None:
        ok = ok | (F.col("confidence") >= min_confidence)
    return valid.filter((F.size("errors") == 0) & ok)


def batches(valid: DataFrame, batch: Column) -> DataFrame:
    """batch, n_patches, n_invalid, accepted of each batch of validated patches; one invalid patch rejects its batch."""
    counted = valid.groupBy(batch.alias("batch")).agg(F.count("*").alias("n_patches"), F.count_if(F.size("errors") > 0).alias("n_invalid"))
    return counted.withColumn("accepted", F.col("n_invalid") == 0)


def latest(patches: DataFrame) -> DataFrame:
    """One row for each patch key: the patch queued last, its position breaking ties. Hot keys are reduced before they are moved."""
    columns = patches.columns
    best = F.max_by(F.struct(*columns), F.struct("queued_at", "queue_pos"))
    return patches.withColumn("key", patch_key()).groupBy("key").agg(best.alias("p")).select("key", "p.*")


def rendered() -> Column:
    """Replacement text of a patch by its operation; target_excerpt is what it replaces."""
    p, op = F.col("payload"), F.col("operation")
    edge = lambda c: md.strip(c, r"\n")
    source = F.filter(F.transform(md.lines(F.col("target_excerpt")), lambda x: md.strip(x)), lambda x: x != "")
    noise = F.transform(F.coalesce(p["noise_lines"], F.array().cast("array<string>")), lambda x: md.strip(x))
    return (
        F.when(op == "replace_block", edge(p["replacement"]))
        .when(op == "wrap_code_block", F.concat(F.lit("```"), F.coalesce(p["code_language"], F.lit("text")), F.lit("\n"), edge(p["content"]), F.lit("\n```")))
        .when(op == "replace_with_table", md.table(p["header"], p["cell_rows"]))
        .when(op == "join_lines", F.coalesce(edge(p["replacement"]), F.call_function("array_join", source, F.coalesce(p["separator"], F.lit(" ")))))
        .when(op == "drop_noise_lines", F.array_join(F.filter(F.transform(md.lines(F.col("target_excerpt")), lambda x: F.regexp_replace(x, f"[{md.SPACE}]+$", "")), lambda x: (md.strip(x) != "") & ~F.array_contains(noise, md.strip(x))), "\n"))
    )


def find(lines: list[str], block: list[str], hint: int | None) -> int | None:
    """Where a block of lines stands: within REACH of the hint from above, else anywhere, first place first."""
    n = len(block)
    if not n:
        return None
    near = range(max(0, (hint or 1) - 1 - REACH), (hint or 1) + REACH) if hint is not None else ()
    for places in (near, range(len(lines) - n + 1)):
        for at in places:
            if lines[at : at + n] == block:
                return at
    return None


def apply_patches(lines: list[str], patches: list[tuple]) -> tuple[list[str], list[str]]:
    """Lines after the patches (key, target, replacement, hint) in key order, and what became of each: applied, skipped or missing."""
    fate = []
    for _, target, text, hint in patches:
        old, new = target.splitlines(), text.splitlines()
        if old == new or find(lines, new, None) is not None and find(lines, old, hint) is None:
            fate.append("skipped")
            continue
        at = find(lines, old, hint)
        if at is None:
            fate.append("missing")
            continue
        lines = [*lines[:at], *new, *lines[at + len(old) :]]
        fate.append("applied")
    return lines, fate


def applied(chapters: DataFrame, patches: DataFrame) -> DataFrame:
    """chapter_path, content, n_applied, n_skipped, n_missing of every chapter (chapter_path, content) after its patches.

    patches: chapter_path, key, target_excerpt, replacement, start_line. Each patch sees the lines as the ones before left them, so
    a chapter's patches go to its row as an array, which its own length bounds. A null content stays null.
    """
    listed = patches.filter("replacement is not null and target_excerpt is not null").groupBy("chapter_path").agg(F.array_sort(F.collect_list(F.struct("key", "target_excerpt", "replacement", "start_line"))).alias("patches"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, todo in batch[["chapter_path", "content", "patches"]].itertuples(index=False):
                if content is None or todo is None:
                    rows.append((path, content, 0, 0, 0))
                    continue
                lines, fate = apply_patches(content.splitlines(), [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in todo])
                rows.append((path, "\n".join(lines), *(fate.count(f) for f in ("applied", "skipped", "missing"))))
            yield pd.DataFrame(rows, columns=["chapter_path", "content", "n_applied", "n_skipped", "n_missing"])

    return chapters.select("chapter_path", "content").join(listed, "chapter_path", "left").mapInPandas(run, "chapter_path string, content string, n_applied int, n_skipped int, n_missing int")
