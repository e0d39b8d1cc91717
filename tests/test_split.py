"""Splitting and tables: invariants and hand-made cases."""

from __future__ import annotations

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from lodestack.functions import split, tables

TEXTS = st.text(alphabet="ab。，.\n 中", max_size=300)


def squeezed(text: str) -> str:
    return "".join(text.split())


@given(TEXTS, st.integers(1, 60))
def test_nothing_is_lost_without_overlap(text, size):
    assert squeezed("".join(split.recursive_split(text, size))) == squeezed(text)


@given(st.text(alphabet="ab，中", max_size=400), st.integers(40, 80))
def test_windows_are_bounded(text, size):
    assert all(len(p) <= size + split.LEAST_TAIL - 1 for p in split.windows(text, size, 0))


def test_levels():
    assert split.recursive_split("aaaa\n\nbbbb\n\ncc", 6) == ["aaaa", "bbbb", "cc"]
    assert split.recursive_split("a. b. c", 4) == ["a.b.", "c"]
    assert split.recursive_split("  ", 5) == [] and split.recursive_split("abc", 0) == ["abc"]
    assert split.recursive_split("甲乙，丙丁戊，己", 4) == ["甲乙，", "丙丁戊，", "己"]


def test_overlap_of_windows():
    parts = split.windows("".join(chr(0x4E00 + i) for i in range(100)), 40, 10)
    assert parts[1].startswith(parts[0][-10:]) and len(parts) == 3


def test_sections():
    assert split.section_pieces("T", "", 10, 0, 1, None) == (["T"], False)
    assert split.section_pieces("T", "body", 10, 0, 1, 50) == (["T\n\nbody"], False)
    parts, cut = split.section_pieces("T", "句子内容很长。" * 20, 30, 0, 1, 60)
    assert cut and all(p.startswith("T\n\n") for p in parts)
    assert split.section_pieces(None, "short", 10, 0, 20, None) == (["short"], False)


def test_short_parts_and_overlaps():
    assert split.with_tails(["a" * 30, "bb", "c" * 30], 20, "\n") == ["a" * 30 + "\nbb", "c" * 30]
    assert split.without_overlaps(["x" * 10 + "0123456789" * 2, "0123456789" * 2 + "y" * 50], 20) == ["x" * 10 + "0123456789" * 2, "y" * 50]


TABLE = "<table><caption>C</caption><thead><tr><th>a</th><th>b</th></tr></thead><tbody>{}</tbody></table>"
ROWS = "".join(f"<tr><td>r{i}</td><td>v|{i}</td></tr>" for i in range(6))


def test_row_groups_cover_all_rows():
    parts = tables.pieces(TABLE.format(ROWS), "T", 60)
    assert [i for p in parts for i in range(p["row_start"], p["row_end"] + 1)] == list(range(6))
    assert all("| a | b |" in p["text"] and p["text"].count("C") == 1 for p in parts)
    assert parts[0]["text"].startswith("T\n\n") and not parts[1]["text"].startswith("T") and "v\\|0" in parts[0]["text"]


def test_odd_tables():
    assert tables.pieces("", "T", 60) == []
    assert tables.pieces("<table><caption>C</caption></table>", None, 60)[0]["kind"] == "table_fallback"
    assert tables.pieces("<table></table>", None, 60)[0]["text"] == tables.EMPTY_TABLE
    head = tables.pieces("<table><tr><td>only</td></tr></table>", None, 60)
    assert [(p["row_start"], p["row_end"], p["cols"]) for p in head] == [(0, -1, 1)]
    assert tables.parse("<table><tr><td>lost<td>kept</td></tr></table>").headers == ["kept"]
    assert tables.parse("<table><tr><td>a<table><tr><td>in</td></tr></table></td></tr></table>").headers == ["ain"]


def test_long_row_stands_alone():
    rows = "<tr><td>x</td><td>y</td></tr><tr><td>" + "l" * 90 + "</td><td>y</td></tr><tr><td>x</td><td>y</td></tr>"
    assert [(p["row_start"], p["row_end"]) for p in tables.pieces(TABLE.format(rows), None, 60)] == [(0, 0), (1, 1), (2, 2)]


def test_continuations():
    first, other = TABLE.format(ROWS), TABLE.replace("<th>a</th>", "<th>z</th>").format(ROWS)
    assert tables.goes_on(first, first) and not tables.goes_on(first, other) and tables.goes_on(first, other.replace("C", "续表"))
    assert tables.joined(first, other).count("<tr>") == 13
    plain = "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"
    assert "<th>" not in tables.joined(plain, plain)  # a header row outside a head isn't carried over
    assert tables.joined("x", plain) == "x\n" + plain


def test_ids_and_captions():
    assert tables.with_id("<TABLE><tr></tr></TABLE>", "tbl-001").startswith('<table data-logical-id="tbl-001"')
    assert tables.with_id("a<b", "tbl-001").endswith("<td>a&lt;b</td></tr></tbody></table>")
    assert tables.captioned("<table><tr></tr></table>", [" 表 ", ""]) == "<table><caption>表</caption><tr></tr></table>"
    assert tables.captioned("text", ["c"]).startswith("<table><caption>c</caption>") and tables.captioned(" ", ["c"]) == ""


def test_sliced():
    """Rows are Python objects a few at a time; the result is that of all rows at once."""
    from lodestack.functions import batches

    seen = []

    class Watched:
        def __init__(self, rows):
            self.rows = rows

        def __len__(self):
            return len(self.rows)

        def slice(self, k, n):
            seen.append(n)
            return self.rows.slice(k, n)

    rows = pa.array([None, "a"] * 500)
    assert batches.sliced(lambda t, u: [t, u], pa.list_(pa.string()), Watched(rows), Watched(rows)).to_pylist() == [[t, t] for t in rows.to_pylist()]
    assert len(seen) == 2 * -(-1000 // batches.ROWS) and max(seen) <= 64
    assert batches.sliced(str, pa.string(), pa.array([], pa.string())).to_pylist() == []
