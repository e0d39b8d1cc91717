"""Vectors of texts without a model: hashed character bigrams."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64
#: Characters whose bigrams are counted at once; a longer text is taken alone.
AT_ONCE = 1 << 20


@lru_cache(maxsize=200_000)
def _place(pair: int) -> int:
    """Where a bigram counts: its component, and ``DIMENSIONS`` more if it counts down.

    It is one number of two code points, the first one's one higher, so that 0 stands for none.
    """
    before = pair >> 32
    n = int.from_bytes(hashlib.md5(((chr(before - 1) if before else "") + chr(pair & 0xFFFFFFFF)).encode("utf-8", "surrogatepass")).digest())
    return n % DIMENSIONS + DIMENSIONS * (n >> 1 & 1)


def _counted(texts: list[str]) -> np.ndarray:
    """The vectors of collapsed texts, none of them empty."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(texts)), sizes)
    first = np.ones(len(points), bool)
    first[ends[:-1]] = True
    first[1:] &= row[1:] != row[:-1]
    # A text's first character has no bigram of its own, unless it is the only one.
    pairs = np.where(first, 0, np.concatenate([[0], points[:-1]]) + 1) << 32 | points
    kept = ~first | (sizes[row] == 1)
    distinct, at = np.unique(pairs[kept], return_inverse=True)
    place = np.array([_place(p) for p in distinct.tolist()], np.int64)[at]
    counts = np.bincount(row[kept] * 2 * DIMENSIONS + place, minlength=len(texts) * 2 * DIMENSIONS).reshape(len(texts), 2, DIMENSIONS)
    return (counts[:, 0] - counts[:, 1]).astype(np.float64)


def bigram_vector(text: Column) -> Column:
    """64 components: 1 in the first, then for each bigram of the lower-cased, collapsed text +1 or -1 where its hash says.

    A text of one character is its own bigram; an empty or null one counts as ``<empty>``.
    """

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        told = [" ".join((t or "").lower().split()) or "<empty>" for t in texts.to_pylist()]
        out, at = np.zeros((len(told), DIMENSIONS)), 0
        upto = np.cumsum([len(t) for t in told])
        while at < len(told):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
            out[at:to] = _counted(told[at:to])
            at = to
        out[:, 0] += 1
        return pa.array(list(out), pa.list_(pa.float64()))

    return vectors(text)
