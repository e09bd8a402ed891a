"""HTML document listings, and announcement boards from which entries graduate to episodes.

A listing is a list of class ``fileTree``. Its items come in page order; one that holds a link to ``#`` with four
digits opens a year, which is carried forward; one that holds a link whose onclick opens a document names a document.
Pages are read one by one in the tasks; markup need not be well formed.

* A null page, one without such a list, and one without a document give one row with the problem and no document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# The list's class, the document hook, the board's headings and its line when it is empty.
LIST_CLASS, HOOK = "fileTree", re.compile(r"openDocumentArticle\('([^']+)'\)")
BOARD, EPISODES = "## Tablero de anuncios\n", "## Episodios\n"
NONE_LEFT = "- No se registraron anuncios comunitarios o logísticos en esta sesión.\n"

DOCUMENTS = "ordinal int, year string, title string, filename string, source_class string, problem string"


class _Listing(HTMLParser):
    """Items in page order: (class, [(link's attributes, its text)], depth of the list)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.found, self.items, self.open, self.link = 0, False, [], [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "ul":
            if self.depth or (not self.found and LIST_CLASS in (a.get("class") or "").split()):
                self.depth, self.found = self.depth + 1, True
        elif self.depth and tag == "li":
            if self.open and self.open[-1][2] == self.depth:  # an item ends where the next of its list begins
                self.open.pop()
            self.open.append((a.get("class") or "", [], self.depth))
            self.items.append(self.open[-1])
        elif self.depth and tag == "a" and self.open:
            self.link = (a, [])
            for item in self.open:
                item[1].append(self.link)

    def handle_endtag(self, tag):
        if tag == "ul" and self.depth:
            self.depth -= 1
            while self.open and self.open[-1][2] > self.depth:
                self.open.pop()
        elif tag == "li" and self.open:
            self.open.pop()
        elif tag == "a":
            self.link = None

    def handle_data(self, data):
        if self.link:
            self.link[1].append(data)


def documents(page: str | None) -> Iterator[dict]:
    """Rows of DOCUMENTS for one page."""
    listing = _Listing()
    listing.feed(page or "")
    listing.close()
    year, n = "", 0
    for css, links, _ in listing.items:
        label = lambda link: "".join(link[1]).strip()
        head = next((x for x in links if x[0].get("href") == "#"), None)
        if head and re.fullmatch(r"\d{4}", label(head)):
            year = label(head)
            continue
        hooked = next((x for x in links if x[0].get("onclick")), None)
        name = HOOK.search(hooked[0]["onclick"]) if hooked else None
        if name and name[1].strip():
            n += 1
            yield {"ordinal": n, "year": year, "title": label(hooked), "filename": name[1], "source_class": " ".join(css.split()), "problem": None}
    if not n:
        yield dict.fromkeys(("ordinal", "year", "title", "filename", "source_class")) | {"problem": "no_documents" if listing.found else "no_list"}


def entries(board: str) -> list[str]:
    """Entries of a board: each begins with ``- `` at the start of a line (the first also after white space)."""
    out: list[list[str]] = []
    for line in board.strip().split("\n"):
        if line.startswith("- ") or (not out and line.strip().startswith("- ")):
            out.append([line])
        elif out:
            out[-1].append(line)
    return ["\n".join(x) for x in out]


def graduated(text: str | None, indices: list[int] | None, blocks: list[str] | None) -> tuple[str | None, str]:
    """(text, status): the board's entries at ``indices`` (from 0) go, the blocks come first among the episodes.

    A record that holds all blocks is left alone (already_done), as is one without board, places or episodes."""
    blocks = [b.strip() for b in blocks or []]
    if text is None or not blocks:
        return text, "nothing_to_do"
    if all(b in text for b in blocks):
        return text, "already_done"
    at = text.find(BOARD)
    if at < 0:
        return text, "no_board"
    if not indices:
        return text, "no_places"
    start = at + len(BOARD)
    end = text.find("\n## ", start)
    end = len(text) if end < 0 else end
    if EPISODES not in text:
        return text, "no_episodes"
    left = [e for k, e in enumerate(entries(text[start:end])) if k not in set(indices)]
    text = text[:start] + ("\n\n".join(left) + "\n" if left else NONE_LEFT) + text[end:]
    place = text.find(EPISODES) + len(EPISODES)
    return text[:place] + "\n" + "\n\n".join(blocks) + "\n" + text[place:], "graduated"


def scan_listings(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, DOCUMENTS): the documents that each page lists."""
    id_type = dict(pages.select(id_col).dtypes)[id_col]
    fields = [f.split(" ") for f in DOCUMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, page in enumerate(batch.column("_h").to_pylist()):
                own = list(documents(page))
                at += [i] * len(own)
                found += own
            yield pa.record_batch([batch.column("_id").take(pa.array(at, pa.int64())), *(pa.array([d[c] for d in found], pa.int32() if k == "int" else pa.string()) for c, k in fields)], [id_col, *(c for c, _ in fields)])

    return pages.selectExpr(f"`{id_col}` as _id", f"`{html_col}` as _h").mapInArrow(run, f"`{id_col}` {id_type}, {DOCUMENTS}")


def graduate(records: DataFrame, id_col: str) -> DataFrame:
    """(id, text, status) of records (id, text, places array<int>, blocks array<string>)."""
    id_type = dict(records.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [graduated(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "blocks")))]
            yield pa.record_batch([batch.column("_id"), pa.array([t for t, _ in out], pa.string()), pa.array([s for _, s in out], pa.string())], [id_col, "text", "status"])

    return records.selectExpr(f"`{id_col}` as _id", "text", "places", "blocks").mapInArrow(run, f"`{id_col}` {id_type}, text string, status string")
