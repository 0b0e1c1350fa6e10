"""Noise in text from scanned pages (p1).

Lines are read once for running headers, page numbers and divided words. Misread words are found by anagram hashes in SQL: rare
words are joined with frequent ones whose hash differs by that of a confusion, verified, and ranked. To the known confusions come
those that the corpus shows: pairs of a rare and a frequent word that differ in one place. Hyphens are judged by the evidence of
the joined and the hyphenated word in the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultspark.session import stage_table

# What is printed, and what it is misread as.
CONFUSIONS = [
    ("e", "c"), ("r", "г"), ("t", "f"), ("l", "1"), ("i", "1"), ("o", "0"), ("i", "l"), ("s", "5"), ("n", "ri"), ("h", "b"), ("d", "cl"), ("u", "ii"), ("m", "rn"),
    ("g", "9"), ("q", "9"), ("b", "6"), ("g", "6"), ("f", "ſ"), ("s", "ſ"), ("w", "vv"), ("ll", "ii"), ("b", "8"), ("z", "2"), ("n", "ii"), ("li", "h"), ("nn", "m"), ("ü", "ii"), ("ö", "6"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("a", "а"), ("e", "е"), ("o", "о"), ("p", "р"), ("c", "с"), ("a", "@"), ("s", "$"), ("l", "|"), ("i", "!"), ("e", "€"), ("c", "¢"),
]
#: Signs that stand for a letter inside a word, and at its ends.
SIGNS, END_SIGNS = "@$€£§&|!¢{}©®", "@€¢©®"
#: Characters that a printed Latin word cannot hold.
FOREIGN = f"[0-9гаеорсſ{SIGNS}]"
#: A word is misread if the other is this many times as frequent, and a word with foreign characters if the other is known at all.
RATIO = 8
#: A confusion that so many words show, each in its middle and more often than the reverse by REVERSE times, is as good as a known one.
SUPPORT, REVERSE = 3, 4
#: A word with a confusion that nothing supports must be so many times rarer than the right one, have LETTERS letters, and hold three letters
#: in a row at that place of which OWN times its own count are all that there are; two letters for two others are then too much. A confusion
#: met more than SPREAD times for each word that has it is no confusion but another word.
LONE, LETTERS, OWN, SPREAD = 40, 4, 3, 4
#: Characters of the longest word that is tried with two confusions or learned from, as that takes time by the square of its length.
LONGEST = 80
#: No more confusions than these are broadcast; with more the join is left to the planner.
MOST_BROADCAST = 10_000
#: The anagram hash is taken modulo this prime, so that no word's sum overflows.
PRIME = 2_147_483_629
HYPHENS = "-‐­¬"
#: Marks that never belong to a word.
SOFT = "­¬"

WORD = re.compile(rf"[{END_SIGNS}]?[^\W_]+(?:[-‐'’­¬{SIGNS}][^\W_]+)*[{END_SIGNS}]?")
DIGITS = r"(?=[OolI]*\d)[\dOolI]+"
PAGE = re.compile(
    rf"^\W*(?:(?:page|seite|pagina|página|pg|p|s)\b\.?\s*)?(?:{DIGITS}|[ivxlc]+|第\s*{DIGITS}\s*[頁页]|{DIGITS}\s*(?:of|von|de|/)\s*{DIGITS})[^\w.,;:!?。，；：！？]*$", re.I
)
FIGURE = re.compile(r"^\s*\d+\s*$")
NUMBERED = [
    re.compile(rf"^\W*(?:(?:page|seite|p|s)\b\.?\s*)?{DIGITS}(?:\W+|(?=[⺀-퟿]))", re.I),
    re.compile(rf"(?:\W+|(?<=[⺀-퟿]))(?:(?:page|seite|p|s)\b\.?\s*)?{DIGITS}\W*$", re.I),
    re.compile(r"^[ivxlc]+\W+|\W+[ivxlc]+$", re.I),
]
#: Shapes that confusable letters have in common; both sides of a comparison are put through it.
SHAPES = {"d": "el", "n": "rl", "m": "rrl", "u": "ll", "w": "vv", "i": "l", "1": "l", "0": "o", "5": "s", "9": "g", "6": "h", "b": "h", "8": "h", "c": "e", "f": "t", "г": "r", "а": "a", "е": "e", "о": "o", "р": "p", "с": "e"}
#: Small words as their shapes, and lines whose letters stand apart.
SMALL_WORDS = ["of", "the", "on", "and", "a", "an", "in", "von", "der", "die", "das", "und", "de", "la", "el", "y", "los", "las"]
SPACED = re.compile(r"^(?:\S )+\S(?:\s{2,}(?:\S )*\S)*$")
LINES = "heads array<int>, pages array<int>, words array<struct<line:int,text:string>>, hyphens array<struct<line:int,mark:string,stem:string,next:string,other:int>>"


class _Shapes(dict):
    """Shape of each character by its code, made when first met: nothing for what is neither letter nor digit."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = SHAPES.get(c, c) if c.isalnum() else ""
        return out


_SHAPES = _Shapes()


def shape(text: str) -> str:
    """A text's letters and digits without case, spacing and confusable differences."""
    return unicodedata.normalize("NFKC", text.replace("ſ", "f")).lower().translate(_SHAPES)


SMALL = {shape(w) for w in SMALL_WORDS} | {""}


def essential(text: str) -> list[str]:
    """Shapes of the words of a text without its small words, which slugs leave out; letters set apart are put together first."""
    if SPACED.match(text.strip()):
        text = re.sub(r"(?<=\S) (?=\S)", "", text.strip())
    return [w for w in (shape(w) for w in re.split(r"[\s\-_]+", text)) if w not in SMALL]


def essence(text: str) -> str:
    """The essential words in one. Marked, to tell it from a whole shape."""
    return "~" + "".join(essential(text))


def title_shapes(candidate_id: str | None, heading: str | None, book_title: str | None) -> tuple[set[str], set[str]]:
    """(shapes of the titles of a candidate's book and chapter, shapes one of which every header holds); the slugs of its path stand in for titles that aren't known."""
    parts = (candidate_id or "").split(".md:")[0].split("/")
    chapter = re.sub(r"^\d+-", "", parts[-1]) if len(parts) > 1 else ""
    book = parts[1] if len(parts) > 2 else ""
    whole = {shape(t) for t in (heading, chapter, book_title, book) if t} - {""}
    slugs = [words for t in (chapter, book) if t and (words := essential(t))]
    return whole | {"~" + "".join(words) for words in slugs}, whole | {max(words, key=len) for words in slugs}


def is_header(line: str, titles: set[str]) -> bool:
    """Whether a line is one of the titles in any dress, with or without a page number. A Markdown heading is none."""
    line = line.strip()
    if not line or line[0] == "#":
        return False
    forms = [line, *(cut for n in NUMBERED if (cut := n.sub("", line, count=1)) and cut != line)]
    return any(shape(f) in titles or essence(f) in titles for f in forms)


def analyse(text: str, titles: set[str], held: set[str]) -> tuple[list[int], list[int], list[tuple], list[tuple]]:
    """(header lines, page number lines, words of each other line, possible hyphens) of one excerpt; lines count from 1.

    A figure is a page number unless the line before or after it is a figure too, or the one before announces a list.
    A line's words are given as one text; a word divided at its end stands among the hyphens, with the line of its rest.
    """
    lines = text.split("\n")
    heads = [k for k, line in enumerate(lines, 1) if held and any(h in own for own in [shape(line)] for h in held) and is_header(line, titles)]
    noise = set(heads)
    pages = []
    for k, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare or k in noise or not PAGE.match(bare):
            continue
        around = [lines[j - 1] for j in (k - 1, k + 1) if 1 <= j <= len(lines)]
        if FIGURE.match(line) and (any(FIGURE.match(x) for x in around) or (k > 1 and lines[k - 2].rstrip().endswith((":", "：")))):
            continue
        pages.append(k)
    noise.update(pages)
    words, hyphens = [], []
    found = {k: WORD.findall(line) for k, line in enumerate(lines, 1) if k not in noise and line.strip()}
    after = dict(zip(found, list(found)[1:]))
    first = dict.fromkeys(found, 0)
    last = {k: len(w) for k, w in found.items()}
    for k, own in found.items():
        line = lines[k - 1].rstrip()
        if line[-1] in HYPHENS and own and line[:-1].endswith(own[-1]):
            n = after.get(k, 0)
            rest = found[n][0] if n and found[n] and lines[n - 1].lstrip().startswith(found[n][0]) else ""
            hyphens.append((k, line[-1], own[-1].lower(), rest.lower(), n))
            last[k] -= 1
            if rest:
                first[n] = 1
    for k, own in found.items():
        kept = own[first[k] : last[k]]
        if kept:
            words.append((k, " ".join(kept).lower()))
    return heads, pages, words, hyphens


def excerpts(candidates: DataFrame, patches: DataFrame, books: DataFrame) -> DataFrame:
    """candidate_id, queue_pos (-1 for a source_excerpt), operation, text, heading, book_title of every page text that isn't null."""
    own = candidates.select("candidate_id", F.lit(-1).cast("bigint").alias("queue_pos"), F.lit(None).cast("string").alias("operation"), F.col("source_excerpt").alias("text"), "heading")
    known = candidates.groupBy("candidate_id").agg(F.min("heading").alias("heading"))
    repairs = patches.select("candidate_id", F.col("queue_pos").cast("bigint"), "operation", F.col("payload.replacement").alias("text")).filter("text is not null").join(known, "candidate_id", "left")
    titles = books.filter("book_slug is not null").groupBy(F.col("book_slug").alias("slug")).agg(F.min("book_title").alias("book_title"))
    rows = own.filter("text is not null").unionByName(repairs.select(*own.columns)).withColumn("slug", F.split_part("candidate_id", F.lit("/"), F.lit(2)))
    return rows.join(titles, "slug", "left").drop("slug")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(c, q, *analyse(t, *title_shapes(c, h, b))) for c, q, t, h, b in zip(batch["candidate_id"], batch["queue_pos"], batch["text"], batch["heading"], batch["book_title"])]
        yield pd.DataFrame(rows, columns=["candidate_id", "queue_pos", "heads", "pages", "words", "hyphens"])


def anagram_hash(word):  # noqa: ANN001, ANN201
    """Sum of the fifth powers of a word's character codes, modulo PRIME; no step leaves 64 bits."""

    def power(c):  # noqa: ANN001, ANN202
        code = F.ascii(c).cast("bigint")
        square = code * code % PRIME
        return square * square % PRIME * code % PRIME

    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda s, c: F.when(c == "", s).otherwise((s + power(c)) % PRIME))


def confusions(spark: SparkSession, learned: DataFrame | None = None) -> DataFrame:
    """right, wrong, delta (difference of their anagram hashes) of the known confusions and learned ones (right, wrong)."""
    table = spark.createDataFrame(CONFUSIONS, "right string, wrong string")
    table = table if learned is None else table.unionByName(learned).distinct()
    return table.withColumn("delta", F.pmod(anagram_hash(F.col("wrong")) - anagram_hash(F.col("right")), F.lit(PRIME)))


_REPLACED = """
  filter(transform(sequence(1, length({word}) - length(wrong) + 1),
    i -> if(substr({word}, i, length(wrong)) = wrong, concat(substr({word}, 1, i - 1), right, substr({word}, i + length(wrong))), null)), x -> x is not null)
"""
_PARTS = "array_distinct(concat(split({word}, ''), transform(sequence(1, greatest(length({word}) - 1, 1)), i -> substr({word}, i, 2))))"
#: A word with one or two characters left out, and what they were.
_GAPS = """
  flatten(transform(array(1, 2), k -> transform(sequence(1, greatest(length(word) - k + 1, 1)),
    i -> struct(concat(substr(word, 1, i - 1), '\u0001', substr(word, i + k)) as gapped, substr(word, i, k) as part, i - 1 as before, length(word) - i - k + 1 as after))))
"""


def substitutions(words: DataFrame, known: DataFrame) -> DataFrame:
    """word, n, correct, correct_n, right, wrong, before, after: words (word, n) and more frequent ones (correct, correct_n) that differ in one place.

    One or two characters stand for one or two others. Both sides are joined by the word with the place left out, the most frequent
    word of each such form only, so no group is paired with itself. A place that begins or ends alike is none.
    """
    fit = (F.length("word") >= LETTERS) & (F.length("word") <= LONGEST)
    gaps = lambda rows, n: rows.filter(fit).select("word", n, F.explode(F.expr(_GAPS)).alias("g")).select("word", n, "g.*")
    frequent = gaps(known.select(F.col("correct").alias("word"), "correct_n"), "correct_n").groupBy("gapped").agg(F.max_by(F.struct("word", "part", "correct_n"), F.struct("correct_n", "word")).alias("k"))
    met = gaps(words, "n").join(frequent, "gapped").select("word", "n", F.col("k.word").alias("correct"), F.col("k.correct_n").alias("correct_n"), F.col("k.part").alias("right"), F.col("part").alias("wrong"), "before", "after")
    apart = (F.left("right", F.lit(1)) != F.left("wrong", F.lit(1))) & (F.right("right", F.lit(1)) != F.right("wrong", F.lit(1)))
    turned = F.reverse("right") == F.col("wrong")
    return met.filter(apart & ~turned & (F.col("correct_n") >= RATIO * F.greatest("n", F.lit(1))))


def learned_confusions(pairs: DataFrame) -> DataFrame:
    """right, wrong of confusions that SUPPORT words of substitutions show in their middle; endings of words alternate by grammar, and both ways."""
    inner = pairs.filter("before >= 1 and after >= 2").groupBy("right", "wrong").agg(F.count_distinct("word").alias("support"))
    back = inner.select(F.col("right").alias("wrong"), F.col("wrong").alias("right"), F.col("support").alias("reverse"))
    judged = inner.join(back, ["right", "wrong"], "left")
    return judged.filter((F.col("support") >= SUPPORT) & (F.col("support") >= REVERSE * F.coalesce("reverse", F.lit(0)))).select("right", "wrong")


def lone_readings(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, correct of substitutions whose confusion nothing supports, by the LONE test."""
    ended = lambda word: F.concat(F.lit("^"), word, F.lit("$"))
    three = lambda word, a, b: F.transform(F.sequence(a, b), lambda i: F.substr(word, i, F.lit(3)))
    whole = ended(F.col("word"))
    totals = vocabulary.select("n", F.explode(F.array_distinct(three(whole, F.lit(1), F.length("word").cast("int")))).alias("three")).groupBy("three").agg(F.sum("n").alias("three_n"))
    rare = pairs.filter((F.col("correct_n") >= LONE * F.greatest("n", F.lit(1))) & (F.length("right") + F.length("wrong") <= 3))
    spread = rare.groupBy("right", "wrong").agg(F.sum(F.greatest("n", F.lit(1))).alias("met"), F.count_distinct("word").alias("words")).filter(F.col("met") <= SPREAD * F.col("words"))
    rare = rare.join(spread.select("right", "wrong"), ["right", "wrong"], "left_semi")
    around = three(whole, F.greatest(F.lit(1), F.col("before")), F.least(F.length("word"), F.col("before") + 1 + F.length("wrong")))
    judged = rare.withColumn("three", F.explode(around)).join(totals, "three", "left").groupBy("word", "n", "correct", "correct_n").agg(F.min(F.coalesce("three_n", F.lit(0))).alias("least"))
    return judged.filter(F.col("least") <= OWN * F.greatest("n", F.lit(1))).groupBy("word").agg(F.max_by("correct", F.struct("correct_n", "correct")).alias("correct"))


def corrections(vocabulary: DataFrame, divided: DataFrame) -> DataFrame:
    """word, correct: the misread words of a vocabulary (word, n) and of words met only divided, each with its best-ranked reading.

    One confusion, known or learned, first; words that it doesn't explain are tried with two, and then with one that nothing else
    supports. The more frequent reading wins, then the lesser one. A word is tried if any known word is frequent enough to be its
    reading, whatever the size of the corpus.
    """
    spark = vocabulary.sparkSession
    wanted = vocabulary.unionByName(divided.select("word", F.lit(0).cast("bigint").alias("n"))).groupBy("word").agg(F.max("n").alias("n"))
    letters = (F.length("word") >= 2) & ~F.col("word").rlike(r"^[0-9]+$")
    known = vocabulary.filter((F.col("n") >= 2) & letters & ~F.col("word").rlike(FOREIGN)).select(F.col("word").alias("correct"), F.col("n").alias("correct_n"), anagram_hash(F.col("word")).alias("hash"))
    known = stage_table(known)
    most = known.agg(F.max("correct_n")).first()[0] or 0
    wanted = stage_table(wanted.filter(letters & ((F.col("n") * RATIO <= most) | F.col("word").rlike(FOREIGN))))
    pairs = stage_table(substitutions(wanted, known))
    table = stage_table(confusions(spark, learned_confusions(pairs)))
    table = F.broadcast(table) if table.count() <= MOST_BROADCAST else table

    def readings(forms: DataFrame) -> DataFrame:
        """forms: word, n, form. Known words that are one confusion from the form."""
        tried = forms.withColumn("wrong", F.explode(F.expr(_PARTS.format(word="form")))).join(table, "wrong").withColumn("hash", F.pmod(anagram_hash(F.col("form")) - F.col("delta"), F.lit(PRIME)))
        met = tried.join(known, "hash").filter(F.expr(f"array_contains({_REPLACED.format(word='form')}, correct)"))
        able = (F.col("correct_n") >= RATIO * F.col("n")) | F.col("word").rlike(FOREIGN)
        best = F.max_by("correct", F.struct("correct_n", F.col("correct")))
        return met.filter(able & (F.col("correct") != F.col("word"))).groupBy("word").agg(best.alias("correct"))

    once = stage_table(readings(wanted.withColumn("form", F.col("word"))))
    rest = wanted.join(once, "word", "left_anti")
    forms = rest.filter(F.length("word") <= LONGEST).withColumn("wrong", F.explode(F.expr(_PARTS.format(word="word")))).join(table, "wrong").select("word", "n", F.explode(F.expr(_REPLACED.format(word="word"))).alias("form"))
    twice = stage_table(readings(forms.distinct()))
    explained = once.unionByName(twice)
    return explained.unionByName(lone_readings(pairs.join(explained, "word", "left_anti"), vocabulary))


class Evidence:
    """Staged analysis of all excerpts and what the corpus says about their words."""

    def __init__(self, texts: DataFrame):
        self.texts = texts
        columns = texts.select("candidate_id", "queue_pos", "text", "heading", "book_title")
        self.read = stage_table(columns.mapInPandas(_read, f"candidate_id string, queue_pos bigint, {LINES}"))
        key = ["candidate_id", "queue_pos"]
        self.hyphens = self.read.select(*key, F.explode("hyphens").alias("h")).select(*key, "h.*")
        none = F.lit(None).cast("int")
        whole = self.read.select(*key, F.explode("words").alias("w")).select(*key, F.col("w.line").alias("line"), F.explode(F.split("w.text", " ")).alias("word"), none.alias("other"), none.alias("cut"))
        parted = self.hyphens.filter("next <> ''").select(*key, "line", F.concat("stem", "next").alias("word"), "other", F.length("stem").alias("cut"))
        self.words = whole.unionByName(parted)
        vocabulary = self.words.filter("other is null").groupBy("word").agg(F.count("*").alias("n"))
        self.vocabulary = stage_table(vocabulary.filter(~F.col("word").rlike(r"[\x{2e80}-\x{d7ff}]")))
        divided = self.words.filter("other is not null").select("word").distinct()
        self.corrections = stage_table(corrections(self.vocabulary, divided))

    def misread(self) -> DataFrame:
        """candidate_id, queue_pos, line_no, word, correct of each misread word; of a divided word the line that holds the difference."""
        met = self.words.join(self.corrections, "word")
        line = F.when(F.col("other").isNull() | (F.left("word", F.col("cut")) != F.left("correct", F.col("cut"))), F.col("line")).otherwise(F.col("other"))
        return met.select("candidate_id", "queue_pos", line.alias("line_no"), "word", "correct")

    def divided(self) -> DataFrame:
        """candidate_id, queue_pos, line_no of each line that ends in a mark that divides a word and doesn't belong to it.

        The joined word must be at least as well known as the hyphenated one, misread forms counting as what they stand for.
        At an excerpt's end a stem that begins hyphenated words keeps its mark.
        """
        plain_mark = F.translate("word", "‐", "-")
        known = self.vocabulary.join(self.corrections, "word", "left").select(F.translate(F.coalesce("correct", plain_mark), "‐", "-").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
        known = stage_table(known)
        firsts = known.filter("instr(word, '-') > 0").groupBy(F.substring_index("word", "-", 1).alias("stem")).agg(F.sum("n").alias("first_n"))
        fix = self.corrections.select(F.col("word").alias("joined"), "correct")
        pairs = self.hyphens.select("stem", "next").distinct().withColumns({"joined": F.concat("stem", "next"), "dashed": F.concat("stem", F.lit("-"), "next")})
        pairs = pairs.join(fix, "joined", "left").withColumn("joined", F.coalesce("correct", "joined"))
        pairs = pairs.join(known.select(F.col("word").alias("joined"), F.col("n").alias("joined_n")), "joined", "left")
        pairs = pairs.join(known.select(F.col("word").alias("dashed"), F.col("n").alias("dashed_n")), "dashed", "left").join(firsts, "stem", "left")
        none = F.lit(0).cast("bigint")
        suspended = F.col("next").isin("und", "oder", "and", "or", "y", "o", "to", "bis") & F.col("joined_n").isNull()
        judged = pairs.withColumn("divides", F.when(F.col("next") == "", F.col("first_n").isNull()).otherwise((F.coalesce("joined_n", none) >= F.coalesce("dashed_n", none)) & ~suspended))
        met = self.hyphens.join(judged.select("stem", "next", "divides"), ["stem", "next"])
        return met.filter(F.col("divides") | F.col("mark").isin(*SOFT)).select("candidate_id", "queue_pos", F.col("line").alias("line_no"))

    def found(self) -> DataFrame:
        lines = lambda column, kind: self.read.select("candidate_id", "queue_pos", F.explode(column).alias("line_no"), F.lit(kind).alias("kind"))
        parts = [lines("heads", "header"), lines("pages", "page_number")]
        parts += [self.misread().select("candidate_id", "queue_pos", "line_no", F.lit("misread").alias("kind")), self.divided().withColumn("kind", F.lit("hyphen"))]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.distinct()


def find_damage(candidates: DataFrame, patches: DataFrame, books: DataFrame) -> DataFrame:
    """candidate_id, queue_pos, line_no, kind of each damaged line and kind of damage.

    Null texts have no rows; a patch without a known candidate is read with the titles in its candidate_id's path. Repeated rows
    give one row.
    """
    return Evidence(excerpts(candidates, patches, books)).found()


def paragraphs(text: str, noise: set[int], joins: set[int], fixes: dict[str, str]) -> str:
    """A page text without noise lines, divided words joined, misread words corrected, lines run together into paragraphs.

    Headings, list items, cells and figures keep their lines; between Han characters no space is put.
    """

    def fixed(m: re.Match) -> str:
        word, right = m.group(), fixes.get(m.group().lower())
        if right is None:
            return word
        return right.upper() if word.isupper() and len(word) > 1 else right[:1].upper() + right[1:] if word[:1].isupper() else right

    out: list[str] = []
    current, glue = "", False
    for k, line in enumerate(text.split("\n"), 1):
        if k in noise:
            continue
        line = line.strip()
        if not line:
            if current and not glue:
                out.append(current)
                current = ""
            continue
        own = bool(re.match(r"(#|[-*+|]\s|\d+[.)]\s|```)", line) or re.search(r"\S\s{2,}\S|\t", line) or FIGURE.match(line))
        if own and not glue:
            out += [current, line] if current else [line]
            current = ""
            continue
        if glue or not current:
            current += line
        else:
            han = "⺀" <= current[-1] <= "퟿" or "　" <= current[-1] <= "〿" or "＀" <= current[-1] <= "￯"
            current += line if han or re.search(r"[^\W\d_]-$", current) else " " + line
        glue = k in joins
        if glue:
            current = current[:-1]
    if current:
        out.append(current)
    return "\n\n".join(WORD.sub(fixed, p) for p in out)


def repaired(candidates: DataFrame, patches: DataFrame, books: DataFrame) -> DataFrame:
    """candidate_id, queue_pos, operation, text: every page text as continuous, correct paragraphs."""
    evidence = Evidence(excerpts(candidates, patches, books))
    key = ["candidate_id", "queue_pos"]
    null_safe = lambda a, b: a["candidate_id"].eqNullSafe(b["candidate_id"]) & (a["queue_pos"] == b["queue_pos"])
    fixes = evidence.misread().groupBy(*key).agg(F.collect_set(F.struct("word", "correct")).alias("fixes"))
    joins = evidence.divided().groupBy(*key).agg(F.collect_set("line_no").alias("joins"))
    texts = evidence.texts.select(*key, "operation", "text").distinct()
    read = evidence.read.select(*key, F.concat("heads", "pages").alias("noise")).distinct()
    for other, column in ((read, "noise"), (fixes, "fixes"), (joins, "joins")):
        texts = texts.join(other, null_safe(texts, other), "left").select(*[texts[c] for c in texts.columns], other[column])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = lambda x: [] if x is None else list(x)
        for batch in batches:
            batch["text"] = [paragraphs(t, set(listed(n)), set(listed(j)), {w["word"]: w["correct"] for w in listed(f)}) for t, n, j, f in zip(batch["text"], batch["noise"], batch["joins"], batch["fixes"])]
            yield batch[[*key, "operation", "text"]]

    return texts.mapInPandas(run, "candidate_id string, queue_pos bigint, operation string, text string")
