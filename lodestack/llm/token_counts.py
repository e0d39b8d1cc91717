"""Token counts by prefix dynamic programming: the exact count at every prefix of a piece, without encoding again.

A text is split into pieces by the vocabulary's pattern. In a piece, the count at each byte prefix is one more than that
of the prefix which its last token leaves; so one table answers the count of the whole, of any prefix, and where a
budget is spent.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import others, quoted
from lodestack.llm.bpe import Remembered, Vocabulary, coded, splitter

# Fixed value: how a byte-level vocabulary splits a text before it merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Tables of pieces that a worker keeps, twice as many at most: about 250 bytes each.
TABLES = 150_000


def _byte_of_letter() -> dict[str, int]:
    """Byte-level files write printable bytes as themselves and the others as the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounts:
    """Counts for a byte-level tokenizer file (.json) without normaliser, whose special strings count as one token each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = _byte_of_letter()
        raw = lambda word: bytes(letters[c] for c in word)
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        ranks = {raw(c): i for i, c in enumerate(letters)} | {raw(a + b): 256 + i for i, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in told["added_tokens"]]
        self.vocabulary, self.find = Vocabulary(ranks), splitter(BYTE_LEVEL)
        #: The stored table of each piece, at most 64 characters long, that came up of late.
        self.tables = Remembered(self._prefixes, TABLES)

    def _prefixes(self, piece: str) -> bytes | array:
        """The count at the end of each byte prefix of a piece."""
        counts: list[int] = []
        for end, token in enumerate(self.vocabulary.last_tokens(piece.encode()), 1):
            before = end - len(self.vocabulary.bytes_of[token])
            counts.append(1 + (counts[before - 1] if before else 0))
        return bytes(counts) if len(counts) < 256 else array("I", counts)

    def parts(self, text: str):
        """Stretches between special strings, in order; each special string stands as (string, True)."""
        at = 0
        while self.special:
            found = min((x for s in self.special if (x := (text.find(s, at), s))[0] >= 0), default=None)
            if found is None:
                break
            if found[0] > at:
                yield text[at : found[0]], False
            yield found[1], True
            at = found[0] + len(found[1])
        if at < len(text):
            yield text[at:], False

    def count(self, text: str) -> int:
        tables = self.tables
        return sum(1 if special else sum(tables[p][-1] for p in self.find(part)) for part, special in self.parts(text))

    def measure(self, texts: list[str], limits: list[int]) -> tuple[list[int], list[list[int]]]:
        """For each text its count, and for each of ``limits`` the bytes of the texts that so many tokens hold, as ``count`` and ``fitting`` tell them.

        However many limits there are, a text is split once and a piece's table is worked out once.
        """
        marked = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        n: list[int] = []
        fit: list[list[int]] = [[] for _ in limits]
        for pieces, codes, many in coded([None if i in marked else t for i, t in enumerate(texts)], self.find):
            tokens = np.concatenate([[0], np.cumsum(np.array([self.tables[p][-1] for p in pieces], np.int64)[codes])])
            size = np.concatenate([[0], np.cumsum(np.array([len(p.encode()) for p in pieces], np.int64)[codes])])
            ends = np.cumsum(many)
            starts = ends - many
            n += (tokens[ends] - tokens[starts]).tolist()
            for limit, out in zip(limits, fit, strict=True):
                last = np.minimum(np.searchsorted(tokens, tokens[starts] + limit, "right") - 1, ends)
                whole = (size[last] - size[starts]).tolist()
                left = (limit - (tokens[last] - tokens[starts])).tolist()
                out += [w if k == e else w + self._within(pieces[codes[k]], x) for w, k, e, x in zip(whole, last.tolist(), ends.tolist(), left, strict=True)]
        for i in marked:
            n[i] = self.count(texts[i])
            for limit, out in zip(limits, fit, strict=True):
                out[i] = self.fitting(texts[i], limit)
        return n, fit

    def _within(self, piece: str, limit: int) -> int:
        """Bytes of the longest prefix of a piece that ends with a character and has at most ``limit`` tokens: a look-up in its table."""
        raw, counts = piece.encode(), self.tables[piece]
        return next((i for i in range(len(raw), 0, -1) if counts[i - 1] <= limit and (i == len(raw) or raw[i] & 0xC0 != 0x80)), 0)

    def fitting(self, text: str, limit: int) -> int:
        """Bytes of the longest run of leading whole pieces and one piece's prefix whose tokens, as encoded, fit in ``limit``.

        These are the first tokens of the whole text's encoding as far as whole pieces go; within the piece that goes
        beyond the limit, the longest prefix that ends with a character and counts as few as are left.
        """
        spent = used = 0
        for part, special in self.parts(text):
            pieces = [part] if special else self.find(part)
            sums = list(accumulate([1] if special else (self.tables[p][-1] for p in pieces)))
            k = bisect_right(sums, limit - spent)
            used += len("".join(pieces[:k]).encode())
            if k < len(pieces):
                return used + (0 if special else self._within(pieces[k], limit - spent - (sums[k - 1] if k else 0)))
            spent += sums[-1]
        return used


@lru_cache(maxsize=4)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def token_counts(text: Column, path: str, limit: int) -> Column:
    """Struct of ``n_tokens`` and ``fit_bytes`` (what of the text ``limit`` tokens hold); null counts as empty."""

    @F.arrow_udf("n_tokens bigint, fit_bytes bigint")
    def counted(texts: pa.Array) -> pa.Array:
        known = prefix_counts(path)
        n, fit = known.measure([t or "" for t in texts.to_pylist()], [limit])
        return pa.StructArray.from_arrays([pa.array(np.array(x, np.int64)) for x in (n, fit[0])], ["n_tokens", "fit_bytes"])

    return counted(text)


def budgets(text: Column, path: str, limits: list[int]) -> Column:
    """An array of the bytes of the text that each of ``limits`` tokens holds, in their order; null counts as empty.

    All are answered from the tables of one pass over the text: it is never encoded again for another limit.
    """

    @F.arrow_udf("array<bigint>")
    def fitted(texts: pa.Array) -> pa.Array:
        _, fit = prefix_counts(path).measure([t or "" for t in texts.to_pylist()], limits)
        return pa.array([list(x) for x in zip(*fit, strict=True)] if limits else [[]] * len(texts), pa.list_(pa.int64()))

    return fitted(text)


def count_documents(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_bytes``.

    ``path`` is a byte-level tokenizer file that every worker can read. Null texts count as empty: 0 bytes, 0 tokens.
    Repeated rows are counted each. Own columns with these names are replaced. Rows aren't moved.
    """
    kept = others(docs, ["n_bytes", "n_tokens", "over_limit", "fit_bytes"])
    told = docs.select(F.struct(*quoted(kept)).alias("row"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), token_counts(F.col(text), path, limit).alias("counted"))
    return told.select("row.*", "n_bytes", "counted.n_tokens", (F.col("counted.n_tokens") > limit).alias("over_limit"), "counted.fit_bytes")
