"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece exactly one token can be last: the one whose neighbour to the left, itself the last
token of a shorter prefix, keeps the boundary between them. The table of last tokens gives the ids by walking back from
the end, an append goes on from the table's end, and an edit keeps the table up to the first changed byte.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import others, quoted

#: Pieces that a worker remembers of late, pairs of neighbours whose boundary it has judged, and characters taken at once.
PIECES = 60_000
PAIRS = 150_000
AT_ONCE = 1_500_000


class Vocabulary:
    """Ranks of byte strings, the halves each token was merged from, and which neighbours keep their boundary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.ends = ahocorasick.Automaton()  # at each byte, the tokens of two bytes and more that end there, longest first
        for b, r in ranks.items():
            if len(b) > 1:
                self.ends.add_word(b.decode("latin-1"), (r, len(b)))
        self.ends.make_automaton()
        top = max(self.bytes_of, default=0) + 1
        self.left, self.right = [-1] * top, [-1] * top  # the halves a token was merged from
        self.joined: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        for token in sorted(self.bytes_of):
            whole = self.bytes_of[token]
            for i in range(1, len(whole)):
                left, right = ranks.get(whole[:i], token), ranks.get(whole[i:], token)
                if left < token and right < token and self._boundary(left, right):
                    self.left[token], self.right[token] = left, right
                    self.joined[left << 32 | right] = token
                    break

    def _boundary(self, a: int, b: int) -> bool:
        """Whether no merge straddles the place where a ends and b begins.

        Unwinds the tokens that touch the boundary from the latest merge to the earliest. While two of them touch, their
        own merge comes first if its rank is lower than that of the merge which took either away; among equal ranks
        the merge further left comes first.
        """
        limit, joined, left, right = 1 << 60, self.joined, self.left, self.right
        while True:
            if joined.get(a << 32 | b, limit) < limit:
                return False
            if a > b and right[a] >= 0:
                limit, a = a, right[a]
            elif left[b] >= 0:
                limit, b = b + 1, left[b]
            elif right[a] >= 0:
                limit, a = a, right[a]
            else:
                return True

    def boundary(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._boundary(a, b)
        return known

    def last_tokens(self, piece: bytes, table: list[int] | None = None) -> list[int]:
        """The last token of each prefix; entry i - 1 is that of the first i bytes. ``table`` has those of a shorter prefix.

        A prefix that no longer token may end has its last byte's own token.
        """
        single, known = self.single, 0 if table is None else len(table)
        pairs, table = self.pairs, [*(table or ()), *[-1] * (len(piece) - known)]
        for end, (token, size) in self.ends.iter(piece.decode("latin-1")):
            if end >= known and table[end] < 0:
                before = end - size
                if before < 0:
                    table[end] = token
                    continue
                last = table[before]
                if last < 0:
                    last = table[before] = single[piece[before]]
                good = pairs.get(last << 32 | token)
                if self.boundary(last, token) if good is None else good:
                    table[end] = token
        if -1 in table:
            table = [single[piece[i]] if t < 0 else t for i, t in enumerate(table)]
            if -1 in table:
                raise ValueError(f"the vocabulary lacks byte {piece[table.index(-1)]}")
        return table

    def walk_back(self, table: list[int], end: int | None = None) -> list[int]:
        """The ids of the first ``end`` bytes."""
        end, ids = len(table) if end is None else end, []
        while end:
            ids.append(table[end - 1])
            end -= len(self.bytes_of[ids[-1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        return self.walk_back(self.last_tokens(piece))


class EditableText:
    """The tokens of one text, kept exact under appends and edits without encoding the rest again."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.pattern, self.text = vocabulary, regex.compile(pattern), ""
        self.pieces: list[tuple[int, str, list[int]]] = []  # start, piece, last tokens
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, put: str) -> None:
        """Replaces text[start:end]. Pieces are matched anew from the second before the edit until they fall in step again."""
        old, shift = self.pieces, len(put) - (end - start)
        self.text = self.text[:start] + put + self.text[end:]
        k = 0
        low, high = 0, len(old)
        while low < high:  # the first piece that reaches the edit
            mid = (low + high) // 2
            low, high = (mid + 1, high) if old[mid][0] + len(old[mid][1]) < start else (low, mid)
        k = max(0, low - 1)
        rest = {at + shift: i for i, (at, _, _) in enumerate(old[k:], k) if at >= end}
        fresh, at = [], old[k][0] if k < len(old) else 0
        for m in self.pattern.finditer(self.text, at):
            if m.start() in rest and m.start() > start + len(put):
                fresh += [(s + shift, p, t) for s, p, t in old[rest[m.start()] :]]
                break
            was = next((x for x in old[k : k + len(fresh) + 3] if x[0] == m.start()), None)
            raw, table = m[0].encode(), []
            if was:
                before = was[1].encode()
                same = next((i for i, (x, y) in enumerate(zip(before, raw, strict=False)) if x != y), min(len(before), len(raw)))
                table = was[2][:same]
            fresh.append((m.start(), m[0], self.vocabulary.last_tokens(raw, table)))
        self.pieces = old[:k] + fresh

    @property
    def ids(self) -> list[int]:
        return [i for _, _, table in self.pieces for i in self.vocabulary.walk_back(table)]


class Remembered(dict):
    """Results of ``make`` by piece. At ``most`` entries they become the old half; what is asked for again moves back."""

    def __init__(self, make, most: int = PIECES):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


def _latin(pattern: str) -> str:
    """``pattern`` for texts within Latin-1, with the classes that only ``regex`` knows spelt out."""
    # Letters, numbers and white space among the first 256 code points.
    classes = {r"\p{L}": r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": r"\t-\r\x20\x85\xa0"}
    out, inside = "", False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        if part == r"\S":
            out += f"[^{classes[chr(92) + 's']}]"
        elif part in classes:
            out += classes[part] if inside else f"[{classes[part]}]"
        else:
            inside = part == "[" or inside and part != "]"
            out += part
    return out


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """A function from a text to its matches. Latin-1 texts go through ``re``, which needs half the time of ``regex``."""
    latin, full = re.compile(_latin(pattern)).findall, regex.compile(pattern).findall

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return latin(text)

    return find


@lru_cache(maxsize=4)
def rank_file(path: str) -> Vocabulary:
    """The vocabulary of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def coded(texts: list[str | None], find) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Stretches of ``texts``: their distinct pieces, which of these stand there in order, and how many each text has."""
    at = 0
    while at < len(texts):
        size, flat, many = 0, [], []
        while at < len(texts) and size < AT_ONCE:
            found = find(texts[at]) if texts[at] else []
            size += len(texts[at] or "")
            flat.append(found)
            many.append(len(found))
            at += 1
        pieces = pa.array(list(chain.from_iterable(flat)), pa.string()).dictionary_encode()
        yield pieces.dictionary.to_pylist(), pieces.indices.to_numpy(), np.array(many, np.int64)


def spread(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each code in turn its run in ``values``, where run k has ``sizes[k]`` entries."""
    starts, length = np.cumsum(sizes) - sizes, sizes[codes]
    return values[np.repeat(starts[codes] - np.cumsum(length) + length, length) + np.arange(length.sum())]


def summed(each: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sums of successive runs of ``each`` with ``many`` entries."""
    ends = np.cumsum(many)
    upto = np.concatenate([[0], np.cumsum(each)])
    return upto[ends] - upto[ends - many]


@lru_cache(maxsize=4)
def _memory(path: str, pattern: str):
    encode = rank_file(path).encode
    return splitter(pattern), Remembered(lambda piece: array("i", encode(piece.encode())).tobytes())


def _encode(texts: pa.Array, path: str, pattern: str) -> pa.ListArray:
    find, known = _memory(path, pattern)
    ids, sizes = [], []
    for pieces, codes, many in coded(texts.to_pylist(), find):
        raw = [known[p] for p in pieces]
        size = np.array([len(r) // 4 for r in raw], np.int64)
        ids.append(spread(np.frombuffer(b"".join(raw), np.int32), size, codes))
        sizes.append(summed(size[codes], many))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes or [[]]))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids or [np.array([], np.int32)])))


def encoded(text: Column, ranks_path: str, pattern: str) -> Column:
    """Token ids of a text column (array of int); null counts as empty, and an empty text has no ids.

    ``ranks_path`` is a rank file that every worker can read, such as one of an installed package.
    """

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        return _encode(texts, ranks_path, pattern)

    return ids_of(text)


@lru_cache(maxsize=4)
def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids one after the other, and how many each id has; ids run from 0 without gaps."""
    known = rank_file(path).bytes_of
    every = [known[i] for i in range(len(known))]
    return np.frombuffer(b"".join(every), np.uint8), np.array([len(b) for b in every], np.int64)


def _decode(rows: pa.ListArray, path: str) -> pa.Array:
    table, sizes = _byte_table(path)
    many = np.array([n or 0 for n in rows.value_lengths().to_pylist()], np.int64)
    codes = rows.flatten().to_numpy(zero_copy_only=False)
    ends, out, at = np.cumsum(many), [], 0
    while at < len(many):  # rows of about as many ids as are taken at once, one row at least
        begin = ends[at] - many[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + AT_ONCE // 4, "right")))
        raw = spread(table, sizes, codes[begin : ends[to - 1]]).tobytes()
        cut = np.concatenate([[0], np.cumsum(summed(sizes[codes[begin : ends[to - 1]]], many[at:to]))]).tolist()
        out += [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)]
        at = to
    return pa.array(out, pa.binary())


def decoded(ids: Column, ranks_path: str) -> Column:
    """The bytes that an array of ids stands for (binary); null counts as empty, an unknown id fails."""

    @F.arrow_udf("binary")
    def bytes_of(rows: pa.Array) -> pa.Array:
        return _decode(rows, ranks_path)

    return bytes_of(ids)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns and rows of ``docs`` with ``ids``, an array of int; an own column ``ids`` is replaced."""
    return docs.withColumn("ids", encoded(F.col(text), ranks_path, pattern))


def decode_documents(tokens: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """All columns and rows of ``tokens`` with ``decoded`` (binary); an own column ``decoded`` is replaced."""
    return tokens.withColumn("decoded", decoded(F.col(ids), ranks_path))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns and rows of ``docs`` with ``ids`` and ``decoded``, what the ids stand for.

    As ``decode_documents`` after ``encode_documents``, but in one pass: Spark would run the encoder once for the ids and
    again below the decoder, or hold workers for each.
    """

    @F.arrow_udf("ids array<int>, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        ids = _encode(texts, ranks_path, pattern)
        return pa.StructArray.from_arrays([ids, _decode(ids, ranks_path)], ["ids", "decoded"])

    kept = others(docs, ["ids", "decoded"])
    return docs.select(F.struct(*quoted(kept)).alias("row"), both(F.col(text)).alias("both")).select("row.*", "both.ids", "both.decoded")
