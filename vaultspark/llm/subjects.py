"""Subject areas of documents (p9): latent Dirichlet topics fitted over the whole corpus, without labels.

Every document's words are counted; the vocabulary leaves out words that nearly all documents of a language share. Topics start from
words that stand in the same documents, become clusters of all documents and are then fitted by distributed EM over all of them. Each
topic is named through its top terms: by the subject whose labelled documents hold them. A passage takes the subject its words speak for, given its document's topic
proportions, and a document the subjects that take about a fifth of its passages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.session import spread, stage_table

#: Topics fitted: about two for each subject and language; of a small corpus one for FEWEST documents and WORDS_EACH words at most, but not
#: fewer than subjects for the latter.
TOPICS, FEWEST, WORDS_EACH = 80, 5, 20
#: Figures by which a word's company in all documents is told, and rounds of clustering words by it.
FIGURES, WORD_ROUNDS = 64, 20
#: Rounds of clustering all documents, and those after which clusters of few documents give way to halves of loose ones.
CLUSTER_ROUNDS, SPLITS = 4, (1, 2)
#: Parts of an even share of the documents: a cluster below the first gives way, one below the second isn't halved.
FEW, MANY = 0.1, 0.3
#: Rounds of EM over all documents, and updates of a document's proportions within one.
ROUNDS, INNER = 2, 4
ALPHA, BETA = 0.1, 0.02
#: A word of the vocabulary is in at least this share of the documents, and in RARE of them. As a document has few distinct words, the
#: vocabulary is bounded by their number over the share, however large the corpus.
LEAST_DF, RARE = 1 / 20_000, 3
#: A word in more than this share of the documents of any language is no word of a subject; twice an even share where subjects are few.
COMMON = 0.3
TOP_TERMS = 30
#: A topic is a subject's if its terms raise the odds of it so many times over those in all labels, and speak for it so many times more
#: than for the next subject; else it is nobody's.
LIFT, CLEAR = 3.0, 1.4
#: Log-odds of a passage, as a part of those of a word that only one subject has, from which on it has a subject.
SURE = 0.75
#: Share of all passages, and of those with a subject, from which on a subject is one of the document's. What is written for a fifth of
#: a document often counts for less of it, as passages are few and whole.
LEAST_SHARE, SHARE = 0.1, 0.12

WORD = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]+)*")
LINK = re.compile(r"\[\[[^\]]*\]\]|\]\([^)]*\)|https?://\S+")
SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|(?<=[。！？])")
ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
CALLOUT = re.compile(r"^(?:>\s*)+(?:\[![^\]]*\]\s*)?")
RULE = re.compile(r"^[\s|:=_*~-]*$")


def passages(text: str) -> list[str]:
    """Sentences, list items, table and code lines of a Markdown text; titles, headings, links, rules and front matter are left out.

    Front matter begins with the first line that isn't blank and ends at the next `---`, however long, if all its lines are fields.
    """
    out: list[str] = []
    lines = text.replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    k, n, fence, prose = 0, len(lines), False, []

    def flush() -> None:
        if prose:
            out.extend(s for s in SENTENCE.split(" ".join(prose)) if s and not RULE.match(s))
            prose.clear()

    header = next((i for i, line in enumerate(lines) if line.strip()), None)
    if header is not None and lines[header].strip() == "---":
        end = next((i for i in range(header + 1, n) if lines[i].strip() == "---"), None)
        if end is not None and all(":" in x or not x.strip() or x.startswith((" ", "-")) for x in lines[header + 1 : end]):
            k = end + 1
    while k < n:
        line = lines[k].strip()
        k += 1
        if line.startswith("```") or line.startswith("~~~"):
            flush()
            fence = not fence
        elif fence:
            if line:
                out.append(line)
        elif not line or line[0] == "#" or RULE.match(line):
            flush()
        elif line[0] == "|":
            flush()
            out.append(line)
        elif ITEM.match(line):
            flush()
            out.append(line)
        else:
            prose.append(CALLOUT.sub("", line) if line[0] == ">" else line)
    flush()
    return out


class Words:
    """64-bit hashes of words, kept once met; of runs of Han and kana the pairs of characters are the words."""

    def __init__(self) -> None:
        self.known: dict[str, list[int]] = {}

    @staticmethod
    def terms(word: str) -> list[str]:
        low = word.lower()
        return [low[i : i + 2] for i in range(len(low) - 1)] if "⺀" <= low[0] <= "퟿" else [low]

    @staticmethod
    def key(term: str) -> int:
        return xxhash.xxh3_64_intdigest(term.encode("utf-8", "replace")) - (1 << 63)

    def of(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) > 200_000:
                self.known.clear()
            ids = self.known[word] = [self.key(t) for t in self.terms(word)]
        return ids

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """(words, end of each passage among them) of a text; passages without words are left out."""
        ids: list[int] = []
        ends: list[int] = []
        for passage in passages(text) if text else []:
            if "[" in passage or "http" in passage:
                passage = LINK.sub(" ", passage)
            found = WORD.findall(passage)
            if found:
                for word in found:
                    known = self.known.get(word)
                    ids += self.of(word) if known is None else known
                ends.append(len(ids))
        return ids, ends


TOKENS = "doc_id bigint, lang string, ids array<bigint>, ends array<int>"
CODED = "doc_id bigint, ids array<int>, ends array<int>, words array<int>, counts array<int>"


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, offsets from 0) of a column of lists without nulls."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def tokenised(documents: DataFrame) -> DataFrame:
    """doc_id, lang (two letters), ids (words), ends (of passages among them) of every document with a text. The column lang may be missing."""
    lang = F.coalesce(F.lower(F.left("lang", F.lit(2))), F.lit("")) if "lang" in documents.columns else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                each = [words.tokens(t) for t in part.column("text").to_pylist()]
                sizes = [np.cumsum([0, *(len(e[k]) for e in each)]) for k in (0, 1)]
                ids = np.fromiter((i for e in each for i in e[0]), np.int64, sizes[0][-1])
                ends = np.fromiter((i for e in each for i in e[1]), np.int32, sizes[1][-1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), _lists(ids, sizes[0]), _lists(ends, sizes[1])], ["doc_id", "lang", "ids", "ends"])

    texts = spread(documents).filter("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint"), lang.alias("lang"), "text")
    return texts.mapInArrow(run, TOKENS)


def vocabulary(tokens: DataFrame, n_subjects: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes of the words that topics are made of, documents with each, number of documents with words)."""
    some = tokens.filter(F.size("ids") > 0)
    sizes = {r.lang: r.n for r in some.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # at most as many as pairs of letters
    total = sum(sizes.values())
    large = [(lang, n) for lang, n in sizes.items() if n >= 20 and n >= 0.01 * total]
    if not large:
        large = [(lang, n) for lang, n in sizes.items()]
    share = max(COMMON, 2 / n_subjects)
    limit = F.coalesce(*[F.when(F.col("lang") == lang, n * share) for lang, n in large], F.lit(float(total)))
    met = some.select("lang", F.explode(F.array_distinct("ids")).alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    kept = met.groupBy("word").agg(F.sum("n").alias("n"), F.bool_or(F.col("n") > limit).alias("common")).filter(~F.col("common") & (F.col("n") >= max(RARE, LEAST_DF * total)))
    found = kept.select("word", "n").toPandas().sort_values("word")
    return found["word"].to_numpy(np.int64), found["n"].to_numpy(np.int64), total


def coded(tokens: DataFrame, words: np.ndarray) -> DataFrame:
    """doc_id, ids (places in the vocabulary), ends, words (its distinct ids, sorted), counts of every document.

    Words outside the vocabulary are left out, their passages stay.
    """
    sent = tokens.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids, at = _flat(batch.column("ids"))
            ends, ends_at = _flat(batch.column("ends"))
            place = np.searchsorted(known, ids)
            kept = known[np.minimum(place, len(known) - 1)] == ids
            before = np.concatenate([[0], np.cumsum(kept)])
            starts = before[at]
            own = np.repeat(np.arange(batch.num_rows), np.diff(ends_at))
            ends = (before[ends + at[own]] - starts[own]).astype(np.int32)
            inside = place[kept].astype(np.int32)
            doc, word, n = word_counts(inside, starts, len(known))
            words_at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            lists = [_lists(inside, starts), _lists(ends, ends_at), _lists(word.astype(np.int32), words_at), _lists(n.astype(np.int32), words_at)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids", "ends", "words", "counts"])

    return tokens.select("doc_id", "ids", "ends").mapInArrow(run, CODED)


def word_counts(ids: np.ndarray, at: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, count) of a batch, sorted; at are the documents' offsets."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pairs, n = np.unique(doc * n_words + ids, return_counts=True)
    return pairs // n_words, pairs % n_words, n.astype(np.float32)


def counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, count) of a batch with words and counts, sorted."""
    word, at = _flat(batch.column("words"))
    return np.repeat(np.arange(batch.num_rows), np.diff(at)), word, _flat(batch.column("counts"))[0].astype(np.float32)


def blocks(doc: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, first place of each document, document of each place) of blocks of whole documents that stay in the cache."""
    if not len(doc):
        return
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    cuts = [0, *starts[np.flatnonzero(np.diff(starts // 1500)) + 1].tolist(), len(doc)]
    for a, b in zip(cuts, cuts[1:]):
        own = doc[a:b]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield a, b, at, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(own))))


def add_by_word(sums: np.ndarray, word: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(word, kind="stable")
    word = word[order]
    at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sums[word[at]] += np.add.reduceat(rows[order], at, axis=0)


def expected(doc: np.ndarray, word: np.ndarray, n: np.ndarray, beta: np.ndarray, sums: np.ndarray) -> None:
    """Add the topic weights of a batch's words to sums: variational updates of each document's proportions."""
    ones = np.ones(beta.shape[1], np.float32)
    for a, b, at, local in blocks(doc):
        w, c = word[a:b], n[a:b]
        like = beta[w]
        theta = np.ones((len(at), beta.shape[1]), np.float32)
        for _ in range(INNER):
            phi = (theta + np.float32(ALPHA))[local]
            phi *= like
            phi *= (c / (phi @ ones + np.float32(1e-30)))[:, None]
            theta = np.add.reduceat(phi, at, axis=0)
        add_by_word(sums, w, phi)


def normalised(counts: np.ndarray) -> np.ndarray:
    smooth = counts + BETA
    return (smooth / smooth.sum(0)).astype(np.float32)


def weighed(doc: np.ndarray, word: np.ndarray, n: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Weights of a batch's words, those of each document being of length 1."""
    x = np.sqrt(n) * rarity[word]
    return (x / np.sqrt(np.bincount(doc, x * x) + 1e-18)[doc]).astype(np.float32)


def company(doc: np.ndarray, word: np.ndarray, x: np.ndarray, signs: np.ndarray, sums: np.ndarray) -> None:
    """Add to sums, for each word of a batch, the projections by signs of what else is in its documents."""
    for a, b, at, local in blocks(doc):
        own = signs[word[a:b]] * x[a:b, None]
        rest = np.add.reduceat(own, at, axis=0)[local] - own
        rest *= x[a:b, None]
        add_by_word(sums, word[a:b], rest)


def nearest(doc: np.ndarray, word: np.ndarray, x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, likeness to it, likeness to the next one) of each document with words of a batch."""
    best, top, second = [np.empty(0, int)], [np.empty(0, np.float32)], [np.empty(0, np.float32)]
    for a, b, at, _ in blocks(doc):
        like = centres[word[a:b]]
        like *= x[a:b, None]
        like = np.add.reduceat(like, at, axis=0)
        best.append(like.argmax(1))
        each = np.arange(len(at))
        top.append(like[each, best[-1]])
        like[each, best[-1]] = -1
        second.append(like.max(1))
    return np.concatenate(best), np.concatenate(top), np.concatenate(second)


def unit(columns: np.ndarray) -> np.ndarray:
    return (columns / (np.linalg.norm(columns, axis=0) + 1e-9)).astype(np.float32)


def word_clusters(profile: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Cluster (of k at most) of each word: spherical clusters of profiles, from frequent words whose company differs most."""
    length = np.linalg.norm(profile, axis=1)
    x, weight = profile / (length + 1e-9)[:, None], np.sqrt(weight / weight.sum())
    centres, far = [int(weight.argmax())], (length > 0).astype(float)
    while True:
        far = np.minimum(far, (1 - x @ x[centres[-1]]).clip(0))
        if len(centres) == k or not far.any():
            break
        centres.append(int((far * weight).argmax()))
    middle = x[centres]
    for _ in range(WORD_ROUNDS):
        of = (x @ middle.T).argmax(1)
        total = np.zeros_like(middle)
        np.add.at(total, of, x * weight[:, None])
        there = np.linalg.norm(total, axis=1) > 0
        middle[there] = total[there] / np.linalg.norm(total[there], axis=1, keepdims=True)
    return (x @ middle.T).argmax(1)


def split(centres: np.ndarray, far: np.ndarray, sizes: np.ndarray, likeness: np.ndarray, clear: np.ndarray) -> np.ndarray:
    """Centres (sums of documents) in which clusters of few documents give way to halves of the loosest ones.

    far are the sums of those documents that are less like their centre than others; likeness to it, and how much more than to the
    next one (clear), are summed. A small cluster that is clearer than documents are on the whole stays.
    """
    out, even = centres.copy(), sizes.sum() / len(sizes)
    few = np.flatnonzero((sizes < FEW * even) & (clear * sizes.sum() <= clear.sum() * sizes))
    loose = [k for k in np.argsort(likeness / np.maximum(sizes, 1), kind="stable") if sizes[k] >= MANY * even and far[:, k].any()]
    for a, b in zip(few, loose):
        out[:, a], out[:, b] = far[:, b], centres[:, b] - far[:, b]
    return out


def _summed(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, weights) of partial rows (word, w0, ...); there is one row for each word of the vocabulary at most."""
    out = rows.groupBy("word").agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(k)]).toPandas()
    return out["word"].to_numpy(int), out[[f"w{j}" for j in range(k)]].to_numpy(float)


def _weights(k: int) -> str:
    return "word int, " + ", ".join(f"w{j} float" for j in range(k))


def _rows(sums: np.ndarray) -> pa.RecordBatch:
    there = np.flatnonzero(sums.any(1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(sums[there, j].astype(np.float32)) for j in range(sums.shape[1]))], ["word", *(f"w{j}" for j in range(sums.shape[1]))])


def fit_topics(docs: DataFrame, df: np.ndarray, n_docs: int, n_subjects: int) -> np.ndarray:
    """Weights (words by topics) of latent Dirichlet topics over all documents (words, counts); df are the documents with each word.

    Every step is a pass over all documents, run where they are, of which only sums are gathered: the company of each word, by which
    words are clustered; clusters of documents, from those of words; EM, from the counts of the documents' clusters.
    """
    spark = docs.sparkSession
    some = docs.filter(F.size("words") > 0).select("words", "counts")
    n_words = len(df)
    topics = max(2, min(TOPICS, n_docs // FEWEST, max(n_subjects, n_words // WORDS_EACH)))
    rarity = np.log(n_docs / df).clip(0.1).astype(np.float32)

    def summed(add: Callable[..., None], n_rows: int, k: int, *values: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros((n_rows, k))
            for batch in batches:
                add(*counted(batch), own, *sent.value)
            yield _rows(own)

        sums = np.zeros((n_rows, k))
        place, weights = _summed(some.mapInArrow(run, _weights(k)), k)
        sums[place] = weights
        return sums

    def met(doc: np.ndarray, word: np.ndarray, n: np.ndarray, own: np.ndarray, signs: np.ndarray, rarity: np.ndarray) -> None:
        company(doc, word, weighed(doc, word, n, rarity), signs, own)

    def cluster(doc: np.ndarray, word: np.ndarray, n: np.ndarray, own: np.ndarray, centres: np.ndarray, rarity: np.ndarray, mean: np.ndarray) -> None:
        """Sums of the documents of each cluster, sums of those less like it than mean, their number, likeness and clearness; without mean, counts."""
        x = weighed(doc, word, n, rarity)
        best, top, second = nearest(doc, word, x, centres)
        place = np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]]))[: len(doc)]
        at = word * np.int64(topics) + best[place]
        if not len(mean):
            own += np.bincount(at, n, own.size).reshape(own.shape)
            return
        far = (top < mean[best])[place]
        own[:n_words] += np.bincount(at, x, n_words * topics).reshape(n_words, topics)
        own[n_words:-3] += np.bincount(at[far], x[far], n_words * topics).reshape(n_words, topics)
        own[-3:] += [np.bincount(best, minlength=topics), np.bincount(best, top, topics), np.bincount(best, top - second, topics)]

    def em(doc: np.ndarray, word: np.ndarray, n: np.ndarray, own: np.ndarray, beta: np.ndarray) -> None:
        expected(doc, word, n, beta, own)

    signs = (np.random.default_rng(0).integers(0, 2, (n_words, FIGURES)) * 2 - 1).astype(np.float32)
    of = word_clusters(summed(met, n_words, FIGURES, signs, rarity), df, topics)
    centres = np.zeros((n_words, topics))
    centres[np.arange(n_words), of] = rarity * np.sqrt(df / n_docs)
    mean = np.zeros(topics, np.float32)
    for k in range(CLUSTER_ROUNDS - 1):
        sums = summed(cluster, 2 * n_words + 3, topics, unit(centres), rarity, mean)
        centres, (sizes, likeness, clear) = sums[:n_words], sums[-3:]
        if k in SPLITS:
            centres = split(centres, sums[n_words:-3], sizes, likeness, clear)
        mean = (likeness / np.maximum(sizes, 1)).astype(np.float32) if k + 1 in SPLITS else np.zeros(topics, np.float32)
    sums = summed(cluster, n_words, topics, unit(centres), rarity, mean[:0])
    for _ in range(ROUNDS):
        sums = summed(em, n_words, topics, normalised(sums))
    return sums


def label_shares(docs: DataFrame, labels: DataFrame, codes: list[str], n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labelled documents with each word, their subjects' shares with each word, shares over all of them).

    A label given twice by one annotator counts once; a null or unknown subject counts for none.
    """
    k = len(codes)
    votes = labels.filter("doc_id is not null").select("doc_id", "annotator", "subject_code").distinct().groupBy("doc_id").agg(F.count("*").alias("votes"), *[F.count_if(F.col("subject_code") == c).alias(f"v{j}") for j, c in enumerate(codes)])
    joined = docs.select("doc_id", "words").join(votes, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_words + 1, k + 1))
        for batch in batches:
            share = np.stack([batch.column(f"v{j}").to_numpy() for j in range(k)], 1) / batch.column("votes").to_numpy()[:, None]
            word, at = _flat(batch.column("words"))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
            np.add.at(sums, word, np.column_stack([np.ones(len(doc)), share[doc]]))
            sums[n_words] += [batch.num_rows, *share.sum(0)]
        yield _rows(sums)

    word, weights = _summed(joined.select("words", "votes", *[f"v{j}" for j in range(k)]).mapInArrow(run, _weights(k + 1)), k + 1)
    sums = np.zeros((n_words + 1, k + 1))
    sums[word] = weights
    return sums[:-1, 0], sums[:-1, 1:], sums[-1, 1:] / max(sums[-1, 0], 1)


def top_terms(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the vocabulary, weights) of each topic's top terms: those that are likelier in it than in the corpus, weighed by how often it has them."""
    beta, mean = normalised(sums), (sums.sum(1) + BETA) / (sums + BETA).sum()
    weight = beta * np.log(beta / mean[:, None])
    top = np.argsort(-weight, axis=0, kind="stable")[:TOP_TERMS].T
    return top, np.take_along_axis(weight.T, top, 1).clip(0)


def topic_subjects(sums: np.ndarray, met: np.ndarray, shares: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Subject of each topic, -1 for none: whose labelled documents hold its top terms."""
    of_term = (shares + usual) / (met + 1)[:, None]
    out = []
    for top, weight in zip(*top_terms(sums)):
        weight = weight * (met[top] > 0)
        vote = weight @ of_term[top] / max(weight.sum(), 1e-12)
        best, *rest = np.sort(vote)[::-1].tolist()
        k = int(vote.argmax())
        raised = best * (1 - usual[k]) >= LIFT * usual[k] * (1 - best)
        out.append(k if best > 0 and raised and best >= CLEAR * max(rest, default=0) else -1)
    return np.array(out)


def word_odds(sums: np.ndarray, subject_of: np.ndarray, n_subjects: int) -> np.ndarray:
    """Log-odds of each word's subjects against even shares; what a word has in topics of no subject weakens them."""
    of = np.stack([sums[:, subject_of == s].sum(1) for s in range(n_subjects)], 1)
    own = of.sum(1, keepdims=True) / (sums.sum(1, keepdims=True) + 1e-9)
    share = of / (of.sum(0) + 1e-9)
    share = share / (share.sum(1, keepdims=True) + 1e-30)
    share = share * own + 0.01 * (1 - own) / n_subjects + 0.002
    return np.log(share / share.sum(1, keepdims=True) * n_subjects + 0.02) * own


def judge(ids: np.ndarray, at: np.ndarray, ends: np.ndarray, ends_at: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, subject) pairs of a batch: from proportions of its passages, found by EM over them; ends are relative to their document."""
    n_docs, k = len(at) - 1, odds.shape[1]
    doc_of = np.repeat(np.arange(n_docs), np.diff(ends_at))
    if not len(ids) or not len(doc_of):
        return np.empty(0, int), np.empty(0, int)
    stops = ends + at[doc_of]
    running = np.concatenate([np.zeros((1, k)), np.cumsum(odds[ids], axis=0)])
    begins = np.concatenate([[0], stops[:-1]])
    begins[ends_at[:-1][np.diff(ends_at) > 0]] = at[:-1][np.diff(ends_at) > 0]
    score = running[stops] - running[begins]
    theta = np.ones((n_docs, k)) / k
    total = np.maximum(np.bincount(doc_of, minlength=n_docs), 1)[:, None]
    first = np.flatnonzero(np.concatenate([[True], doc_of[1:] != doc_of[:-1]]))
    for _ in range(INNER):
        phi = score + np.log(theta[doc_of] + ALPHA / k)
        phi = np.exp(phi - phi.max(1, keepdims=True))
        phi *= (score.max(1) > SURE * np.log(max(k, 2)))[:, None] / phi.sum(1, keepdims=True)
        theta[doc_of[first]] = np.add.reduceat(phi, first, axis=0)
        theta /= total
    best = (score + np.log(theta[doc_of] + ALPHA / k)).argmax(1)
    sure = score[np.arange(len(best)), best] > SURE * np.log(max(k, 2))
    n = np.bincount(doc_of[sure] * k + best[sure], minlength=n_docs * k).reshape(n_docs, k)
    return np.nonzero((n >= LEAST_SHARE * total - 1e-9) & (n >= SHARE * n.sum(1, keepdims=True) - 1e-9) & (n > 0))


class Fitted:
    """Staged documents, their vocabulary, the topics and the subjects these are named by."""

    def __init__(self, documents: DataFrame, labels: DataFrame, subjects: DataFrame):
        self.codes = sorted(r.subject_code for r in subjects.filter("subject_code is not null").select("subject_code").distinct().collect())  # a list of subject areas, ten at any scale
        self.subject_of = np.empty(0, int)
        if not self.codes:
            return
        tokens = stage_table(tokenised(documents))
        self.words, df, n_docs = vocabulary(tokens, len(self.codes))
        if not len(self.words):
            return
        self.docs = stage_table(coded(tokens, self.words))
        self.sums = fit_topics(self.docs, df, n_docs, len(self.codes))
        self.subject_of = topic_subjects(self.sums, *label_shares(self.docs, labels, self.codes, len(self.words)))


def assign(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc_id, subject_code: one row for each subject that takes about a fifth of a document's passages.

    Null, empty and blank texts have no row; a repeated doc_id has its subjects once. Without labels or subjects no topic can be
    named and there are no rows.
    """
    spark, schema = documents.sparkSession, "doc_id bigint, subject_code string"
    fitted = Fitted(documents, labels, subjects)
    if not (fitted.subject_of >= 0).any():
        return spark.createDataFrame([], schema)
    codes = np.array(fitted.codes, dtype=object)
    sent = spark.sparkContext.broadcast(word_odds(fitted.sums, fitted.subject_of, len(codes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                doc, subject = judge(*_flat(part.column("ids")), *_flat(part.column("ends")), sent.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(codes[subject], pa.string())], ["doc_id", "subject_code"])

    return fitted.docs.mapInArrow(run, schema).distinct()


def topics(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """topic, subject_code (null = of none), place, term, weight: the TOP_TERMS top terms of each topic, for inspection."""
    spark = documents.sparkSession
    fitted = Fitted(documents, labels, subjects)
    if not len(fitted.subject_of):
        return spark.createDataFrame([], "topic int, subject_code string, place int, term string, weight double")
    code = [fitted.codes[s] if s >= 0 else None for s in fitted.subject_of]
    terms, weights = top_terms(fitted.sums)
    top = [(t, code[t], place, int(fitted.words[w]), float(x)) for t in range(len(code)) for place, (w, x) in enumerate(zip(terms[t], weights[t]), 1) if x > 0]
    wanted = spark.createDataFrame(top, "topic int, subject_code string, place int, word bigint, weight double")
    sent = spark.sparkContext.broadcast({w for _, _, _, w, _ in top})

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, str] = {}
        met: set[str] = set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for word in set(WORD.findall(text)) - met:
                    met.add(word)
                    seen.update((key, term) for term in Words.terms(word) if (key := Words.key(term)) in sent.value)
                if len(met) > 200_000:
                    met.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.string())], ["word", "term"])

    named = documents.filter("text is not null").select("text").mapInArrow(spelt, "word bigint, term string").groupBy("word").agg(F.min("term").alias("term"))
    return wanted.join(named, "word", "left").select("topic", "subject_code", "place", "term", "weight")


def composition(assigned: DataFrame) -> DataFrame:
    """subject_code, n_docs of the corpus."""
    return assigned.groupBy("subject_code").agg(F.count("*").alias("n_docs"))
