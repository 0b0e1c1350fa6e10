"""Visually identical text with different characters (p5).

Values are mapped to the characters they look like, grouped under the accent-sensitive collation UNICODE, and each class takes one
member: a plain one where it has any, the most frequent, then the least; else the mapped form. Plain values are their own members.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.session import stage_table

# Letters of other alphabets, in the published table of confusable characters, and the Latin letters they look like.
CYRILLIC = dict(zip("асеіјорѕухһԁԛԝӏгѵҽѡАВЕІЈКМНОРЅСТУХԚԜҮѴӀԌ", "aceijopsyxhdqwlrvewABEIJKMHOPSCTYXQWYVIG"))
GREEK = dict(zip("αιορυνχγκϲϳησΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϜϺ", "aiopuvxykcjnoABEZHIKMNOPTYXCJFM"))
ARMENIAN = dict(zip("օսհոցզյՕՍՏԼ", "ouhngqjOUSL"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏳᏴ", "DRTAJEWMHYGZRWVSLCPKGB"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
COPTIC = dict(zip("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABEHIKMNOPCTYXopc"))
PHONETIC = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "Ɩ": "I", "ı": "i", "ȷ": "j", "ʋ": "u", "ƿ": "p"}
# Invisible characters outside the format category, and styles of dash and quotation mark that stay as they are.
INVISIBLE = {"͏", "ᅟ", "ᅠ", "ㅤ", "ﾠ", "឴", "឵", *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0x180B, 0x1810)), *map(chr, range(0xE0100, 0xE01F0))}
STYLES = set("‑″‴⁗‶‷´¨¯¸˜᾽᾿῾")

SCRIPTS = {"cyrillic": CYRILLIC, "greek": GREEK, "armenian": ARMENIAN, "cherokee": CHEROKEE, "lisu": LISU, "coptic": COPTIC}
#: Where the letters of each script stand.
RANGES = [("latin", 0, 0x24F), ("greek", 0x370, 0x3E1), ("coptic", 0x3E2, 0x3EF), ("greek", 0x3F0, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("cherokee", 0x13A0, 0x13FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("coptic", 0x2C80, 0x2CFF), ("lisu", 0xA4D0, 0xA4FF), ("cyrillic", 0xA640, 0xA69F)]
BACK = {script: {latin: letter for letter, latin in reversed(table.items())} for script, table in SCRIPTS.items()}  # the first of several
WORD = regex.compile(r"[\p{L}\p{M}]+")
SMALL_CAPITAL = regex.compile(r"(?:MODIFIER LETTER|LATIN LETTER) SMALL CAPITAL ([A-Z])")
ODD = r"[^\t\n\r\x{20}-\x{7e}]"


def plain_characters(value: str) -> str:
    """Without invisible characters, other spaces and compatibility forms; accents composed with their letters."""
    out = []
    for c in value:
        kind = unicodedata.category(c)
        if c in "\x85  " or kind == "Zs":
            out.append(" ")
        elif kind == "Cf" or c in INVISIBLE or (kind == "Cc" and c not in "\t\n\r"):
            continue
        elif c in STYLES:
            out.append(c)
        else:
            out.append(unicodedata.normalize("NFKC", c) if unicodedata.category(c) != "Mn" else c)
    return unicodedata.normalize("NFC", "".join(out))


@functools.cache
def script(c: str) -> str | None:
    """The script of a letter by its code; None for other characters and scripts."""
    return next((name for name, first, last in RANGES if first <= ord(c) <= last and c.isalpha()), None)


@functools.cache
def phonetic(c: str) -> str | None:
    """The Latin letter that a letter of phonetic script looks like; small capitals by their names. None for others."""
    small = SMALL_CAPITAL.fullmatch(unicodedata.name(c, ""))
    return PHONETIC.get(c) or (small[1] if small else None)


def swapped(c: str, table: dict[str, str]) -> str | None:
    """A letter's look-alike in a table, its accents kept; None where it has none."""
    if c in table:
        return table[c]
    base, *marks = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", table[base] + "".join(marks)) if marks and base in table else None


def map_word(word: str) -> tuple[str, str | None]:
    """A word in the alphabet that most of its letters belong to, unmistakable ones counting twice, and a doubtful Latin reading.

    Where no letter is unmistakably of another alphabet it is Latin. Phonetic letters give way to those they look like, in the case of the others.
    A word of a single other alphabet whose letters all look Latin stays as it is, with its Latin reading beside it.
    """
    if any(phonetic(c) for c in word):
        low = any(c.islower() and not phonetic(c) for c in word) or not any(c.isupper() for c in word)
        word = "".join((p.lower() if low and not c.isupper() else p) if (p := phonetic(c)) else c for c in word)
    used = {s for c in word if (s := script(c))}
    foreign = used - {"latin"}
    if not foreign:
        return word, None
    if len(used) == 1:
        letters = [(swapped(c, SCRIPTS[next(iter(used))]) if script(c) else c) for c in word]
        return word, "".join(letters) if None not in letters else None
    total, sure = dict.fromkeys(used, 0), dict.fromkeys(used, 0)
    for c in word:
        if s := script(c):
            total[s] += 1
            sure[s] += not any(swapped(c, BACK[o]) for o in foreign) if s == "latin" else swapped(c, SCRIPTS[s]) is None
    target = max(sorted(used), key=lambda s: (sure[s] + total[s], sure[s], s == "latin")) if any(sure[s] for s in foreign) else "latin"
    out = []
    for c in word:
        s = script(c)
        if s and s != target:
            latin = c if s == "latin" else swapped(c, SCRIPTS[s]) or c
            c = latin if target == "latin" else swapped(latin, BACK[target]) or c
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out)), None


def look(value: str) -> tuple[str, list[tuple[str, str | None]]]:
    """(mapped value, its parts with the Latin reading of each doubtful word)."""
    plain, parts, end = plain_characters(value), [], 0
    for m in WORD.finditer(plain):
        if m.start() > end:
            parts.append((plain[end : m.start()], None))
        parts.append(map_word(m.group()))
        end = m.end()
    if end < len(plain):
        parts.append((plain[end:], None))
    return "".join(p for p, _ in parts), parts


LOOKS = pa.list_(pa.struct([("part", pa.string()), ("latin", pa.string())]))


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [[{"part": p, "latin": latin} for p, latin in look(v)[1]] for v in batch.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("n"), pa.array(parts, LOOKS)], ["value", "n", "parts"])


def field_values(rows: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """id, field_name, value of every non-null value."""
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("e")
    return rows.select(F.col(id_column).alias("id"), entries).select("id", "e.*").filter(F.col("value").isNotNull())


def mapped_values(values: DataFrame) -> DataFrame:
    """value, n, mapped of the distinct values that hold any character beyond printable ASCII, tab and line end.

    A doubtful word is read as Latin where that reading is a word of a plain value; each word of a value is judged by itself.
    """
    odd = values.filter(F.col("value").rlike(ODD)).groupBy("value").agg(F.count("*").alias("n"))
    seen = stage_table(odd.mapInArrow(_look, "value string, n bigint, parts array<struct<part:string,latin:string>>"))
    wanted = seen.select("value", F.explode(F.filter("parts", lambda p: p["latin"].isNotNull())).alias("p")).select("value", F.lower("p.latin").alias("word"))
    words = values.filter(~F.col("value").rlike(ODD)).select(F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("word")).distinct()
    known = wanted.join(words, "word", "left_semi").groupBy("value").agg(F.collect_set("word").alias("known"))
    latin = lambda p: F.when(p["latin"].isNotNull() & F.array_contains("known", F.lower(p["latin"])), p["latin"]).otherwise(p["part"])
    return seen.join(known, "value", "left").select("value", "n", F.array_join(F.transform("parts", latin), "").alias("mapped"))


def canonical_values(rows: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """id, field_name, value, canonical, is_case of every value that isn't null; values of plain ASCII are canonical as they are."""
    values = field_values(rows, id_column, fields)
    mapped = stage_table(mapped_values(values))
    # plain values of a class are those equal to a mapped form
    plain = values.join(mapped.filter("mapped <> value").select(F.col("mapped").alias("value")).distinct(), "value", "left_semi").groupBy("value").agg(F.count("*").alias("n"))
    members = mapped.unionByName(plain.filter(~F.col("value").rlike(ODD)).withColumn("mapped", F.col("value")))
    best = F.min_by("value", F.struct(F.col("value") != F.col("mapped"), -F.col("n"), F.col("value")))
    classes = members.groupBy(F.collate("mapped", "UNICODE").alias("form")).agg(
        F.when(F.bool_or(F.col("value") == F.col("mapped")), best).otherwise(F.min("mapped")).alias("canonical")
    )
    chosen = mapped.join(classes, F.collate(mapped["mapped"], "UNICODE") == F.col("form")).select("value", "canonical", (F.col("mapped") != F.col("value")).alias("is_case"))
    odd = values.filter(F.col("value").rlike(ODD)).join(chosen, "value").select("id", "field_name", "value", "canonical", "is_case")
    return odd.unionByName(values.filter(~F.col("value").rlike(ODD)).select("id", "field_name", "value", F.col("value").alias("canonical"), F.lit(False).alias("is_case")))


def find_cases(rows: DataFrame, id_column: str = "note_id", fields: tuple[str, ...] = ("title", "concept_key")) -> DataFrame:
    """id, field_name of the values that hold a look-alike, a compatibility form, a loose accent, an invisible character or an odd space.

    Null and empty values are no cases; a repeated row gives one row.
    """
    found = canonical_values(rows, id_column, list(fields)).filter("is_case and canonical <> value")
    return found.select(F.col("id").alias(id_column), "field_name").distinct()
