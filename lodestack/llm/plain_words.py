"""Words of plain runs: digits, letters A-Z lower-cased, and whatever isn't ASCII; all else parts them."""

from __future__ import annotations

from collections.abc import Iterator

#: The bytes of words; A-Z become a-z.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of a text whose words are listed at once.
AT_ONCE = 1 << 20


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


def stretches(raw: bytes, size: int = AT_ONCE) -> Iterator[list[bytes]]:
    """The words of a text, a bounded stretch of it at a time; a word stays whole."""
    plain, at = raw.translate(TABLE), 0
    while at < len(plain):
        to = plain.find(b" ", at + size) if at + size < len(plain) else -1
        to = len(plain) if to < 0 else to
        yield plain[at:to].split()
        at = to
