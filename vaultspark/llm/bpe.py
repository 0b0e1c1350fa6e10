"""Exact byte-level BPE by backtracking (p7).

Longest vocabulary matches come from one Aho-Corasick pass over a piece. A token is taken where it is compatible with the one
before it, that is where merging the two by rank gives them back; else a shorter prefix is tried, and positions from which no
encoding goes on are marked, so each is left at most once. Decoding slices one blob by an offset table.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.session import spread

#: Folder of the public tokenizers; a parameter of every operator.
TOKENIZERS = "/opt/tokenizers"
#: Splits text before merges; fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's cache of pieces; when full it starts anew.
CACHE = 150_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself where it is visible, else one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


def read_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Tokens by id and the merge (left, right) of each; single bytes have (id, id)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = byte_letters()
    size = max(model["vocab"].values()) + 1
    tokens = [b""] * size
    for word, i in model["vocab"].items():
        tokens[i] = bytes(of[c] for c in word) if all(c in of for c in word) else b""
    split = [(i, i) for i in range(size)]
    for merge in model["merges"]:
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        split[model["vocab"][left + right]] = (model["vocab"][left], model["vocab"][right])
    special = {t["id"] for t in json.loads(open(path, encoding="utf-8").read()).get("added_tokens", [])}
    return [b"" if i in special else t for i, t in enumerate(tokens)], split


class BytePairEncoder:
    """Encoder of one vocabulary whose ids follow the order of its merges."""

    def __init__(self, tokens: list[bytes], split: list[tuple[int, int]]):
        self.tokens, self.split = tokens, split
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        self.merged = {pair: i for i, pair in enumerate(split) if pair != (i, i)}
        self.lengths = [len(t) for t in tokens]
        self.shorter = [next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.inside = {(t[k], t[k + 1]) for t in self.ids for k in range(len(t) - 1)}
        self.compatible_pairs: dict[tuple[int, int], bool] = {}
        self.pattern, self.space = regex.compile(PATTERN), regex.compile(r"\s")
        self.chunks = regex.compile(r"\s*\S+|\s+")
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.after_space: dict[str, bytes] = {}
        self.after_line: dict[str, bytes] = {}
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.blob = b"".join(tokens)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both by rank leaves exactly these two tokens.

        The merges are undone latest first, on the sides of the border; a merge across it that would come earlier forbids the pair.
        """
        known = self.compatible_pairs.get((left, right))
        if known is not None:
            return known
        a, b, before, ok = left, right, len(self.tokens), True
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                ok = False
                break
            if a > b:  # the later of the two merges is undone first
                before, inner = a, self.split[a][1]
                if inner != a:
                    a = inner
                    continue
                before, inner = b + 1, self.split[b][0]
                if inner == b:
                    break
                b = inner
            else:
                before, inner = b + 1, self.split[b][0]
                if inner != b:
                    b = inner
                    continue
                before, inner = a, self.split[a][1]
                if inner == a:
                    break
                a = inner
        if len(self.compatible_pairs) > CACHE:
            self.compatible_pairs.clear()
        self.compatible_pairs[left, right] = ok
        return ok

    def encode_bytes(self, piece: bytes) -> list[int]:
        """The merges' result for one piece, in time linear in its length."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, lengths = len(piece), self.lengths
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token
        taken: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + lengths[token]
            if not dead[end] and (not taken or self.compatible(taken[-1], token)):
                taken.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = self.shorter[token]
            while token < 0:  # nothing goes on from here: take back the last token and shorten it
                dead[at] = 1
                last = taken.pop()
                at -= lengths[last]
                token = self.shorter[last]
        return taken

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one match of PATTERN, cut first where no token of the vocabulary joins the neighbouring bytes."""
        known = self.pieces.get(piece)
        if known is not None:
            return known
        raw, ids, start = piece.encode("utf-8", "replace"), array("i"), 0
        if len(raw) != len(piece):
            for k in range(1, len(raw)):
                if (raw[k - 1], raw[k]) not in self.inside:
                    ids.extend(self._part(raw[start:k]))
                    start = k
        ids.extend(self._part(raw[start:]))
        out = ids.tobytes()
        if len(piece) <= 64:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def _part(self, raw: bytes) -> Iterable[int]:
        known = self.parts.get(raw)
        if known is None:
            known = self.encode_bytes(raw)
            if len(raw) <= 32:
                if len(self.parts) >= CACHE:
                    self.parts.clear()
                self.parts[raw] = known
        return known

    def _segment(self, text: str) -> bytes:
        return b"".join(map(self.encode_piece, self.pattern.findall(text)))

    def _chunk(self, part: str) -> bytes:
        """Ids of a space and part, which neither begins nor ends with white space.

        No match of PATTERN goes on from other characters into white space, so a line's end begins a chunk of its own.
        """
        head, *rest = self.chunks.findall(part) if "\n" in part else [part]
        out = self.after_space.get(head)
        if out is None:
            out = self._segment(" " + head)
            if len(head) <= 64:
                if len(self.after_space) >= CACHE:
                    self.after_space.clear()
                self.after_space[head] = out
        for chunk in rest:
            ids = self.after_line.get(chunk)
            if ids is None:
                ids = self._segment(chunk)
                if len(chunk) <= 64:
                    if len(self.after_line) >= CACHE:
                        self.after_line.clear()
                    self.after_line[chunk] = ids
            out += ids
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers.

        A space between two characters that aren't white space always begins a match of PATTERN, so what lies between two
        such spaces is looked up whole. Parts that begin or end with white space are joined up to the next that doesn't.
        """
        parts = text.split(" ")
        got = list(map(self.after_space.get, parts))
        got[0] = None
        i, n = 0, len(parts)
        while True:
            try:
                i = got.index(None, i)
            except ValueError:
                return b"".join(got)
            j = i
            if i and self._clean(parts[i]):
                got[i] = self._chunk(parts[i])
            else:
                while j < n and not (parts[j] and not self.space.match(parts[j][-1]) and (j == 0 or not self.space.match(parts[j][0]))):
                    j += 1
                got[i] = self._segment((" " if i else "") + " ".join(parts[i : j + 1]))
                for k in range(i + 1, min(j + 1, n)):
                    got[k] = b""
            i = j + 1

    def _clean(self, part: str) -> bool:
        return bool(part) and not self.space.match(part[0]) and not self.space.match(part[-1])

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text as it is; none for an empty or null one."""
        return np.frombuffer(self.encode_packed(text), np.int32).tolist() if text else []

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of ids, sliced from the blob of all tokens by their offsets."""
        at = self.offsets
        return b"".join(self.blob[at[i] : at[i + 1]] for i in ids)


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The encoder of a vocabulary file, built once in each process."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(*read_vocabulary(path))
    return _encoders[path]


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.json"


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


def encode_texts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of each text as it is, without special tokens; an empty array for empty and for null text.

    One row for every row of documents, repeated and null doc_ids too; other columns are ignored.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                packed = [own.encode_packed(text) if text else b"" for text in _texts(part)]
                ends = np.cumsum([0, *map(len, packed)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return spread(documents).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of each text; 0 for empty and null text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts = [len(own.encode_packed(text)) // 4 if text else 0 for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return spread(documents).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of ids; bytes that are no UTF-8 become U+FFFD, null ids a null text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
