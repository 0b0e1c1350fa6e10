"""Which of many literal strings occur in a text: one automaton over each block of strings, kept by the worker between tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.session import stage_table

#: Strings that one pass over the texts looks for; more are looked for in further passes, as an automaton must fit a worker.
BLOCK = 100_000

_automata: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, words: list[str]) -> ahocorasick.Automaton:
    """The automaton of a block, built once in each process; the last few blocks are kept."""
    if name not in _automata:
        while len(_automata) >= 4:
            del _automata[next(iter(_automata))]
        made = ahocorasick.Automaton()
        for w in words:
            made.add_word(w, w)
        made.make_automaton()
        _automata[name] = made
    return _automata[name]


def blocks(words: DataFrame, block: int = BLOCK) -> list[list[str]]:
    """Distinct non-empty strings (word) in lists of about `block`; only one list at a time is as large as a driver must hold."""
    wanted = stage_table(words.filter("word <> ''").select("word").distinct())
    n = -(-wanted.count() // block)
    return [[r.word for r in wanted.filter(F.pmod(F.xxhash64("word"), F.lit(n)) == b).collect()] for b in range(n)]


def occurrences(texts: DataFrame, key: str, text: str, words: DataFrame, block: int = BLOCK, own: str | None = None, unlinked: bool = False) -> DataFrame:
    """key, word of each string (word) that occurs in a text, each once for each row. Null texts hold nothing.

    own is a column with a string that doesn't count for its row; unlinked leaves out what a text also holds as [[word]].
    """
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, word string"
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), (F.col(own) if own else F.lit(None).cast("string")).alias("_own"))

    def search(part: list[str]) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = automaton(name, part)
            for batch in batches:
                found = ((k, w, x) for k, x, o in zip(batch[key], batch["_text"], batch["_own"]) for w in {w for _, w in held.iter(x)} if w != o)
                yield pd.DataFrame([(k, w) for k, w, x in found if not unlinked or f"[[{w}]]" not in x], columns=[key, "word"])

        return rows.mapInPandas(run, schema)

    found = [search(part) for part in blocks(words, block) if part]
    return reduce(DataFrame.unionByName, found) if found else texts.sparkSession.createDataFrame([], schema)
