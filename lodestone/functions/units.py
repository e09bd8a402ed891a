"""Lossless partition of texts into review units.

A unit begins at the start of the text, after a page break and after blank lines; a unit longer than ``most``
characters is cut at the first line start at least ``preferred`` characters on, and again while it is too long. No
word has a meaning of its own. The units of a text, joined, are the text.

* A line ends at any of the breaks of ``str.splitlines``; a form feed also closes its page. Without form feeds there
  are no pages (null).
* An empty text is no unit, a null text neither. A line longer than ``most`` stays whole.
* Texts are read one by one in the tasks; a unit's preview has white space collapsed and 280 characters at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# Sizes of a unit and of its preview.
MOST, PREFERRED, PREVIEW = 4_000, 2_800, 280

UNITS = "unit_id string, kind string, page_start int, page_end int, char_start int, char_end int, preview string, text string"


def _boundaries(lines: list[str], most: int, preferred: int) -> list[tuple[int, str]]:
    """(place, kind) of each unit's start."""
    starts = [0, *accumulate(map(len, lines))]
    marks, blank, broke = [(0, "source")], False, False
    for at, line in zip(starts, lines):
        empty = not line.replace("\f", "").strip()
        if at and not empty and (broke or blank):
            marks.append((at, "page" if broke else "block"))
        blank, broke = empty, "\f" in line
    out, line = [], 0
    for (at, kind), (end, _) in zip(marks, [*marks[1:], (starts[-1], "")]):
        out.append((at, kind))
        while end - at > most:
            while line < len(lines) and starts[line] < at + preferred:
                line += 1
            if line == len(lines) or starts[line] >= end:
                break
            at = starts[line]
            out.append((at, "continuation"))
    return out


def units(text: str | None, most: int = MOST, preferred: int = PREFERRED) -> Iterator[dict]:
    """The units of one text."""
    if not text:
        return
    paged = "\f" in text
    marks = _boundaries(text.splitlines(keepends=True), most, preferred)
    lines = [0, *accumulate(map(len, text.splitlines(keepends=True)))]
    page, line = 1, 0

    def page_of(at: int) -> int | None:
        """Page of the line that holds ``at``: breaks count from the line after theirs."""
        nonlocal page, line
        while line + 1 < len(lines) - 1 and lines[line + 1] <= at:
            page += text.count("\f", lines[line], lines[line + 1])
            line += 1
        return page if paged else None

    for n, ((at, kind), (end, _)) in enumerate(zip(marks, [*marks[1:], (len(text), "")]), 1):
        piece = text[at:end]
        first = page_of(at)
        yield {
            "unit_id": f"U{n:04d}", "kind": kind, "page_start": first, "page_end": page_of(max(at, end - 1)), "char_start": at, "char_end": end,
            "preview": " ".join(piece.replace("\f", " ").split())[:PREVIEW], "text": piece,
        }


def review_units(rows: DataFrame, id_col: str, text_col: str, most: int = MOST, preferred: int = PREFERRED) -> DataFrame:
    """(id, unit columns): one row for each unit of each text."""
    if not 0 < preferred <= most:
        raise ValueError("units are cut at or before their greatest size")
    id_type = dict(rows.select(id_col).dtypes)[id_col]
    fields = [f.split(" ") for f in UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32()}
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(units(batch.column("_t")[i].as_py(), most, preferred))
                if found:
                    key = pa.array([batch.column("_id")[i].as_py()] * len(found), batch.schema.field("_id").type)
                    yield pa.record_batch([key, *(pa.array([u[c] for u in found], kinds[k]) for c, k in fields)], [id_col, *(c for c, _ in fields)])

    source = rows.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _t")
    return source.mapInArrow(run, f"`{id_col}` {id_type}, {UNITS}")
