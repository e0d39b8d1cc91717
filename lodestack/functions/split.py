"""Splitting one text into pieces of bounded length: small helpers that column expressions run on each row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.batches import sliced

# Where sentences and soft units end, boundaries that a cut prefers, and bounds.
SENTENCE_ENDS = re.compile(r"(?<=[。！？；.!?;])\s*")
SOFT_ENDS = re.compile(r"(?<=[，、；：:\n])")
STRONG, WEAK = "\n。！？；.!?;", "，、：:"
LEAST_TAIL, MOST_OVERLAP, LEAST_BODY, SOFT_MAX = 20, 200, 32, 1000

Cut = Callable[[str], list[str]]


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in text.split("\n\n") if p.strip()]


def sentences(text: str) -> list[str]:
    return [p.strip() for p in SENTENCE_ENDS.split(text) if p.strip()]


def soft_units(text: str) -> list[str]:
    return [p for p in SOFT_ENDS.split(text) if p.strip()]


#: From the coarsest units to the finest; with what units are joined again.
LEVELS: list[tuple[Cut, str]] = [(paragraphs, "\n\n"), (sentences, ""), (soft_units, "")]


def recursive_split(text: str, size: int, overlap: int = 0) -> list[str]:
    """Pieces of at most ``size`` characters, of the coarsest units that fit; a window cut where no unit does.

    Joining drops the blanks between sentences. Overlap is of window cuts only. Size 0 or less keeps the text whole.
    """
    return list(each_piece(text, size, overlap))


def each_piece(text: str, size: int, overlap: int = 0, level: int = 0) -> Iterator[str]:
    """The pieces of ``recursive_split`` as they are cut."""
    text = text.strip()
    if not text or size <= 0 or len(text) <= size:
        yield from [text] if text else []
        return
    for at in range(level, len(LEVELS)):
        cut, joiner = LEVELS[at]
        units = cut(text)
        if len(units) > 1:
            yield from _packed(units, size, overlap, joiner, at + 1)
            return
    yield from windows(text, size, overlap)


def _packed(units: list[str], size: int, overlap: int, joiner: str, finer: int) -> Iterator[str]:
    """Units joined as long as they fit; one that is too long alone goes to the finer level."""
    held = ""
    for unit in filter(None, (u.strip() for u in units)):
        joined = held + joiner + unit if held else unit
        if len(joined) <= size:
            held = joined
            continue
        if held:
            yield held
        held = ""
        if len(unit) <= size:
            held = unit
        else:
            yield from each_piece(unit, size, overlap, finer)
    if held:
        yield held


def _last_of(marks: str, text: str, low: int, high: int) -> int:
    return max(text.rfind(m, low, high) for m in marks)


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` characters that end after a boundary in their second half if there is one, a strong one first."""
    text, out, at = text.strip(), [], 0
    back = min(max(0, overlap), max(0, size - 1))
    while at + size < len(text):
        low, high = at + max(1, size // 2), at + size
        mark = _last_of(STRONG, text, low, high) if low < high else -1
        if mark < 0 and low < high:
            mark = _last_of(WEAK, text, low, high)
        end = high if mark < 0 else mark + 1
        out.append(text[at:end].strip())
        at = max(at + 1, end - back) if back else end
    out.append(text[at:].strip())
    return with_tails([p for p in out if p], LEAST_TAIL, "")


def with_tails(parts: list[str], least: int, glue: str) -> list[str]:
    """Parts shorter than ``least`` are glued to the part before them; the first stays however short."""
    out: list[str] = []
    for part in filter(None, (p.strip() for p in parts)):
        if out and len(part) < least:
            out[-1] = (out[-1].rstrip() if glue else out[-1]) + glue + part
        else:
            out.append(part)
    while least > 0 and len(out) > 1 and len(out[-1]) < least:
        last = out.pop()
        out[-1] += glue + last
    return out


def without_overlaps(parts: list[str], least: int) -> list[str]:
    """Each part without the beginning that repeats the end of the part before, if that is ``least`` characters or more."""
    out = parts[:1]
    for part in parts[1:] if least > 0 else []:
        longest = min(len(out[-1]), len(part), MOST_OVERLAP, max(least, len(part) // 3))
        same = next((n for n in range(longest, least - 1, -1) if out[-1].endswith(part[:n])), 0)
        part = part[same:].strip()
        if part:
            out.append(part)
    return out if least > 0 else parts


def tidy_pieces(parts: list[str], least: int) -> list[str]:
    return with_tails(without_overlaps(with_tails(parts, least, "\n"), least), least, "\n") if least > 0 else parts


def section_pieces(header: str | None, body: str | None, size: int, overlap: int, least: int, soft_max: int | None) -> tuple[list[str], bool]:
    """A section's pieces, and whether it was cut at all: whole up to the soft maximum, else each piece under the header.

    Without header the body is cut to ``size``; without body the header stands alone.
    """
    header, body = (header or "").strip(), (body or "").strip()
    soft = max(size, soft_max if soft_max and soft_max > 0 else SOFT_MAX)
    if not header:
        parts = recursive_split(body, size, overlap)
    elif not body:
        parts = [header]
    elif len(header) + 2 + len(body) <= soft:
        parts = [f"{header}\n\n{body}"]
    else:
        parts = [f"{header}\n\n{p}" for p in recursive_split(body, max(LEAST_BODY, soft - len(header) - 2), overlap)]
    return tidy_pieces(parts, least), len(parts) > 1


def text_pieces(text: Column, size: int, overlap: int = 0) -> Column:
    """``recursive_split`` of a column: array of string; null gives none."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return sliced(lambda t: recursive_split(t or "", size, overlap), pa.list_(pa.string()), texts)

    return split(text)


def sentence_pieces(text: Column) -> Column:
    """Sentences as ``sentences`` cuts them, by Spark's own split."""
    parts = F.transform(F.split(text, r"(?U)(?<=[。！？；.!?;])\s*"), lambda p: F.regexp_replace(p, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", ""))
    return F.filter(parts, lambda p: p != "")


PIECES = pa.struct([("pieces", pa.list_(pa.string())), ("cut", pa.bool_())])


def sections_split(header: Column, body: Column, size: int, overlap: int, least: int, soft_max: int | None) -> Column:
    """Struct of ``pieces`` and ``cut`` for each section."""

    @F.arrow_udf("pieces array<string>, cut boolean")
    def split(headers: pa.Array, bodies: pa.Array) -> pa.Array:
        return sliced(lambda h, b: dict(zip(PIECES.names, section_pieces(h, b, size, overlap, least, soft_max), strict=True)), PIECES, headers, bodies)

    return split(header, body)
