"""Questions answered by pages: ranking, answer pages and their versions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.operators.search import BLOCK, automaton, occurrences
from vaultspark.session import spread, stage_table

#: Questions scored in one pass over the pages, and in one product of counts and weights.
QUESTION_BLOCK, PRODUCT = 20_000, 1000
#: Numbers in a table of pages by tokens that a task holds.
CELLS = 8_000_000
#: Columns of a registry entry, by the names they have in it.
ENTRY_FIELDS = {c: c for c in ("title", "path", "line_count", "headings", "outbound_links", "inbound_links", "summary", "source_file", "category", "parent", "status", "tags", "chapter", "source_path", "question")} | {"file_format": "format", "note_type": "type"}
TOKEN = re.compile(r"\w+")
HITS = "question_id bigint, doc_id bigint, score bigint"


def question_tokens(question: str) -> list[str]:
    return sorted({t for t in TOKEN.findall(question.lower()) if len(t) >= 2})


def corpus(pages: DataFrame) -> DataFrame:
    """The pages (path, page_type, text) that questions are answered by: no homepage, log, query notes or indexes of their history."""
    history = (F.col("page_type") == "index") & F.col("text").rlike(r"\A---[^\n]*\n(?:[^\n]*\n)*?index_kind:[ \t]*\"?query-history")
    left_out = F.col("path").isin("wiki/index.md", "wiki/log.md") | (F.col("page_type") == "query-note") | history
    return pages.filter(~F.coalesce(left_out, F.lit(False)))


def _best(docs: np.ndarray, scores: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(docs, scores) of each row's best columns: greatest score, then least doc; docs are one row for all, ascending, or one for each."""
    n = scores.shape[1]
    if docs.ndim == 1 and n > limit:
        keys = scores.astype(np.int64) * (n + 1) - np.arange(n)
        top = np.argpartition(-keys, limit - 1, axis=1)[:, :limit]
        return docs[top], np.take_along_axis(scores, top, 1)
    docs = np.broadcast_to(docs, scores.shape)
    order = np.argsort(docs, axis=1, kind="stable")
    docs, scores = np.take_along_axis(docs, order, 1), np.take_along_axis(scores, order, 1)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :limit]
    return np.take_along_axis(docs, order, 1), np.take_along_axis(scores, order, 1)


def ranked(questions: DataFrame, pages: DataFrame, limit: int = 5, hints: DataFrame | None = None) -> DataFrame:
    """question_id, doc_id, score, place: the best pages (doc_id, text) of each question (question_id, question) by occurrences of its tokens.

    Questions are a stated set, taken in blocks. One automaton counts a block's tokens in each page; scores of many pages and
    questions are products of counts and weights, and a task keeps the best `limit` pages of each question, so what is moved is
    bounded by tasks times questions. Ties go to the lesser doc_id; pages with score 0 and null texts are no hits; a null question
    has none.

    hints (doc_id, bonus, entry; one row a page) add to every page's score before any is left out: bonus for each question, and one
    for each of its tokens that occurs in entry, the page's registry entry. A page may be a hit by its hints alone.
    """
    if hints is None:
        pages = pages.withColumns({"bonus": F.lit(0), "entry": F.lit(None).cast("string")})
    else:
        pages = spread(pages).drop("bonus", "entry").join(hints.select("doc_id", "bonus", "entry"), "doc_id", "left")
    asked = stage_table(questions.filter("question is not null and question_id is not null").select(F.col("question_id").cast("bigint"), "question").distinct())
    texts = (spread(pages) if hints is None else pages).filter("text is not null").select(F.col("doc_id").cast("bigint"), F.lower("text").alias("text"), F.coalesce("bonus", F.lit(0)).cast("bigint").alias("bonus"), F.lower("entry").alias("entry"))
    n_blocks = -(-asked.count() // QUESTION_BLOCK)
    out = pages.sparkSession.createDataFrame([], HITS)
    for b in range(n_blocks):
        block = [(r.question_id, question_tokens(r.question)) for r in asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(n_blocks)) == b).collect()]
        words = sorted({t for _, ts in block for t in ts})
        name = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], block: list = block, words: list[str] = words, name: str = name) -> Iterator[pd.DataFrame]:
            found = automaton(name, words)
            place = {w: k for k, w in enumerate(words)}
            parts = []
            for first in range(0, len(block), PRODUCT):
                some = block[first : first + PRODUCT]
                own = sorted({place[t] for _, ts in some for t in ts})
                at = {w: k for k, w in enumerate(own)}
                weight = np.zeros((len(own), len(some)), np.float32)
                for q, (_, ts) in enumerate(some):
                    weight[[at[place[t]] for t in ts], q] = 1
                parts.append([np.array(own, int), weight, np.empty((len(some), 0), np.int64), np.empty((len(some), 0))])
            step = max(50, CELLS // max(1, len(words)))
            for batch in batches:
                for start in range(0, len(batch), step):
                    part = batch.iloc[start : start + step].sort_values("doc_id")
                    counts = np.zeros((len(part), len(words)), np.float32)
                    for row, text in enumerate(part["text"]):
                        free: dict[str, int] = {}
                        for end, w in found.iter(text) if words else ():
                            if end - len(w) >= free.get(w, -1):  # no overlaps with itself
                                counts[row, place[w]] += 1
                                free[w] = end
                    for row, entry in enumerate(part["entry"]):
                        if isinstance(entry, str) and words:
                            counts[row, sorted({place[w] for _, w in found.iter(entry)})] += 1
                    docs, bonus = part["doc_id"].to_numpy(), part["bonus"].to_numpy()[:, None]
                    for p in parts:
                        new_docs, new_scores = _best(docs, (counts[:, p[0]] @ p[1] + bonus).T, limit)
                        p[2], p[3] = _best(np.concatenate([p[2], new_docs], 1), np.concatenate([p[3], new_scores], 1), limit)
            for k, (_, _, docs, scores) in enumerate(parts):
                row, col = np.nonzero(scores > 0)
                ids = np.array([q for q, _ in block[k * PRODUCT : (k + 1) * PRODUCT]])
                yield pd.DataFrame({"question_id": ids[row], "doc_id": docs[row, col], "score": scores[row, col].astype(np.int64)})

        out = out.unionByName(texts.mapInPandas(run, HITS))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def registry_entries(notes: DataFrame) -> DataFrame:
    """page, entry: the registry's entry of each page of the vault, as JSON text; of rows of one path the greatest note_id holds."""
    fields = [F.col(c).alias(ENTRY_FIELDS[c]) for c in notes.columns if c in ENTRY_FIELDS]
    each = notes.filter("path is not null").select(F.concat(F.lit("wiki/"), "path").alias("page"), "note_id", F.to_json(F.struct(*fields)).alias("entry"))
    return each.groupBy("page").agg(F.max_by("entry", "note_id").alias("entry"))


def mentioned(names: DataFrame, lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """name of names that occur in a line (text) of the index, each once."""
    found = occurrences(lines.withColumn("_line", F.lit(0)), "_line", "text", names.select(F.col("name").alias("word")), block)
    return found.select(F.col("word").alias("name")).distinct()


def answers(questions: DataFrame, hits: DataFrame, pages: DataFrame, mode: str = "scaffold") -> DataFrame:
    """question_id, question, body: an answer page for each question, its hits (at most a ranking's limit each) listed by place.

    scaffold lists the sources with previews; synthesize gives up to three conclusions, the evidence and cited pages. A question
    without hits says so.
    """
    wanted = hits.join(pages.select("doc_id", md.summary(F.col("text"), 320).alias("preview"), md.title(F.col("text"), F.lit("untitled")).alias("title")), "doc_id")
    listed = wanted.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "score", "preview", "title"))).alias("hits"))
    rows = questions.filter("question is not null").join(listed, "question_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<place:int,doc_id:bigint,score:bigint,preview:string,title:string>>")))
    link = lambda h: F.concat(F.lit("[["), h["doc_id"].cast("string"), F.lit("]]"))
    if mode == "scaffold":
        entries = F.transform("hits", lambda h: F.concat(F.lit("- "), link(h), F.lit(" (score: "), h["score"].cast("string"), F.lit(")\n  - "), h["preview"]))
        text = F.concat_ws("\n", F.concat(F.lit("# "), F.col("question")), F.lit("## Sources"), F.array_join(entries, "\n"))
    else:
        conclusions = F.transform(F.slice(F.filter("hits", lambda h: h["preview"] != ""), 1, 3), lambda h: F.concat(F.lit("- "), h["preview"]))
        evidence = F.transform("hits", lambda h: F.concat(F.lit("### "), link(h), F.lit(" "), h["title"]))
        text = F.concat_ws("\n", F.concat(F.lit("# "), F.col("question")), F.lit("## Conclusion"), F.array_join(conclusions, "\n"), F.lit("## Evidence"), F.array_join(evidence, "\n"), F.lit("## Cited"), F.array_join(F.transform("hits", lambda h: F.concat(F.lit("- "), link(h))), "\n"))
    return rows.select("question_id", "question", F.when(F.size("hits") == 0, F.concat(F.lit("# "), F.col("question"), F.lit("\nNo matching pages."))).otherwise(text).alias("body"))


def versioned(filed: DataFrame, latest: DataFrame) -> DataFrame:
    """What filing answers back does: slug, version, action of each answer (slug, hash) against the latest version (slug, version, hash).

    The same hash as the latest merges into it; else a new version is made, the first being created.
    """
    known = latest.groupBy("slug").agg(F.max(F.struct("version", "hash")).alias("l"))
    action = F.when(F.col("l").isNull(), "created").when(F.col("l.hash") == F.col("hash"), "merged").otherwise("versioned")
    version = F.coalesce(F.col("l.version"), F.lit(0)) + F.when(F.col("l.hash") == F.col("hash"), 0).otherwise(1)
    return filed.join(known, "slug", "left").select("slug", version.cast("int").alias("version"), action.alias("action"))
