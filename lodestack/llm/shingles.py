"""Sets of hashed word shingles of whole texts, worked out for a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text whose hashes are worked out at once; a longer text is taken alone.
AT_ONCE = 1 << 20

_RANDOM = np.random.RandomState(20_240_229)
_VALUE = _RANDOM.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = _RANDOM.randint(1, 1 << 62, 2 * WORDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bytes of each word of the texts that stand one after the other in ``data``, and how many words each has."""
    first = np.zeros(len(data) + 1, bool)
    first[np.concatenate([[0], ends])] = True
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    start = np.flatnonzero(word & (~before | first[:-1]))
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    w = mixed((total[end] - total[start]) * _powers(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64) * _BASE)
    return w, end - start, np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))


def _hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts that stand one after the other in ``data``, and how many each text has."""
    w, _, many = word_hashes(data, ends)
    begin = np.cumsum(many) - many
    count = np.where(many >= WORDS, many - WORDS + 1, (many > 0).astype(np.int64))
    out = np.empty(count.sum(), np.uint64)
    place = np.cumsum(count) - count
    full = many >= WORDS
    at = np.repeat(begin[full] - (np.cumsum(count[full]) - count[full]), count[full]) + np.arange(count[full].sum())
    h = np.zeros(len(at), np.uint64)
    for j in range(WORDS):
        h += w[at + j] * _PLACES[j]
    out[np.repeat(full, count)] = mixed(h)
    for n in range(1, WORDS):  # a text of fewer words is one shingle, which no longer one equals
        few = many == n
        h = np.full(few.sum(), n, np.uint64)
        for j in range(n):
            h += w[begin[few] + j] * _PLACES[WORDS + j]
        out[place[few]] = mixed(h)
    return out, count


def shingle_sets(texts: pa.Array):
    """For each stretch of ``texts`` its rows' hashes, ascending and distinct in each row, one row after the other, and how
    many each row has. Null and wordless texts have none."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
        to = min(to, len(texts))
        raw, many = _hashes(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at])
        ends = np.cumsum(many)
        sets = [np.unique(raw[e - n : e]) for e, n in zip(ends.tolist(), many.tolist(), strict=True)]
        yield np.concatenate(sets) if sets else raw, np.array([len(s) for s in sets], np.int64)
        at = to
