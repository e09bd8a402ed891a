"""Episodes of Markdown records: from a front-matter head, or else from the headings.

A text that begins with a line ``---`` has a head up to the next such line. The head is read by a small parser: keys
with plain, quoted, number, truth or null values, lists in lines or brackets, and lists of mappings. If it names a
list of episodes, these are the text's; each needs a thread, a date and a title, or is left out with a problem. A
head that cannot be read is reported with its line, and the headings are used.

Headings: after a line ``## Episodios``, lines of the form ``### → Hilo: `name` `` open threads and lines
``#### date — title`` open episodes; a citation block begins with ``> Fuente:`` and runs to a blank line; the next
``## `` line ends the section.

* Null texts have no episodes. A head that is never closed is none. Texts are read one by one in the tasks.
* Tabs in a head's indent, a line that is neither key nor item, an unclosed quote, and a repeated key are errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shared import small_batches

# Headings, marks and field names of the records.
SECTION, CITATION = "## Episodios", "> Fuente:"
THREAD = re.compile(r"^### → Hilo: `([^`]+)`\s*(?:\(condensado\))?\s*$")
EPISODE = re.compile(r"^#### (\d{4}-\d{2}-\d{2}) — (.+)$")
FIELDS = {"thread": "hilo_destino", "date": "fecha", "title": "titulo", "body": "cuerpo", "citation": "cita", "episode_id": "episodio_id", "kind": "tipo"}
LIST, DEFAULT_KIND = "episodios", "evidencia"

COLUMNS = ("origin", "ordinal", "thread", "date", "title", "body", "citation", "episode_id", "kind", "problem", "line")
TYPES = "origin string, ordinal int, thread string, date string, title string, body string, citation string, episode_id string, kind string, problem string, line int"


class HeadError(ValueError):
    def __init__(self, line: int, what: str):
        super().__init__(what)
        self.line, self.what = line, what


def _scalar(text: str, line: int):
    text = text.strip()
    if text[:1] in "\"'" and text:
        quote = text[0]
        end, out = 1, []
        while end < len(text):
            c = text[end]
            if quote == '"' and c == "\\" and end + 1 < len(text):
                out.append({"n": "\n", "t": "\t"}.get(text[end + 1], text[end + 1]))
                end += 2
            elif quote == "'" and text[end : end + 2] == "''":
                out.append("'")
                end += 2
            elif c == quote:
                rest = text[end + 1 :].strip()
                if rest and not rest.startswith("#"):
                    raise HeadError(line, "text after a quote")
                return "".join(out)
            else:
                out.append(c)
                end += 1
        raise HeadError(line, "unclosed quote")
    text = re.sub(r"(^|\s)#.*$", "", text).strip()
    if text.startswith("["):
        if not text.endswith("]"):
            raise HeadError(line, "unclosed list")
        inner = text[1:-1].strip()
        return [_scalar(x, line) for x in re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)\s*(?:,|$)""", inner)] if inner else []
    if text.lower() in ("", "~", "null"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return int(text) if re.fullmatch(r"-?(0|[1-9]\d*)", text) else text


def parse_head(lines: list[tuple[int, str]]):
    """The value of a head's (number, line) pairs; HeadError says where it cannot be read."""
    rows = []
    for number, raw in lines:
        if raw.strip() and not raw.lstrip().startswith("#"):
            indent = raw[: len(raw) - len(raw.lstrip())]
            if "\t" in indent:
                raise HeadError(number, "tab in the indent")
            rows.append((number, len(indent), raw.strip(), raw))
    value, end = _block(rows, 0, rows[0][1]) if rows else ({}, 0)
    if end < len(rows):
        raise HeadError(rows[end][0], "wrong indent")
    return value


def _block(rows, i: int, indent: int):
    """The mapping or list that begins at row ``i`` with this indent, and the row after it."""
    out = [] if rows[i][2].startswith("- ") or rows[i][2] == "-" else {}
    while i < len(rows) and rows[i][1] == indent:
        number, _, text, _ = rows[i]
        item = text == "-" or text.startswith("- ")
        if item != isinstance(out, list):
            raise HeadError(number, "keys and items mixed")
        if item:
            rest = text[1:].lstrip()
            if re.match(r"""[^\s"'\[#][^:]*:(\s|$)""", rest):  # a mapping that begins on the item's line
                inner = indent + len(text) - len(rest)
                rows[i] = (number, inner, rest, rest)
                value, i = _block(rows, i, inner)
            elif rest:
                value, i = _scalar(rest, number), i + 1
            else:
                value, i = _nested(rows, i + 1, indent)
            out.append(value)
            continue
        match = re.match(r"""([^\s"'\[#:-][^:]*):(?:\s+(.*))?$""", text)
        if not match:
            raise HeadError(number, "neither key nor item")
        key, rest = match[1].strip(), match[2]
        if key in out:
            raise HeadError(number, f"repeated key {key}")
        if rest in ("|", ">"):
            i += 1
            body = []
            while i < len(rows) and rows[i][1] > indent:
                body.append(rows[i])
                i += 1
            least = min((r[1] for r in body), default=0)
            out[key] = ("\n" if rest == "|" else " ").join(r[3][least:].rstrip() for r in body)
        elif rest is None or not rest.strip() or rest.lstrip().startswith("#"):
            out[key], i = _nested(rows, i + 1, indent)
        else:
            out[key], i = _scalar(rest, number), i + 1
    return out, i


def _nested(rows, i: int, indent: int):
    """What stands below a key or item without a value: deeper rows, or items at a key's own indent."""
    if i < len(rows) and (rows[i][1] > indent or rows[i][1] == indent and rows[i][2].startswith("- ") and not rows[i - 1][2].startswith("-")):
        return _block(rows, i, rows[i][1])
    return None, i


def _from_head(items: list, line: int) -> Iterator[dict]:
    text = lambda v: "" if v is None else str(v).strip()
    for n, item in enumerate(items, 1):
        if not isinstance(item, dict):
            yield {"ordinal": n, "problem": "not a mapping", "line": line}
            continue
        got = {name: text(item.get(field)) for name, field in FIELDS.items()}
        if got["citation"] and not got["citation"].startswith(CITATION):
            got["citation"] = f"{CITATION} {got['citation']}"
        got["kind"] = got["kind"] or DEFAULT_KIND
        missing = [c for c in ("thread", "title") if not got[c]] + ([] if re.fullmatch(r"\d{4}-\d{2}-\d{2}", got["date"]) else ["date"])
        yield got | {"ordinal": n, "problem": f"needs {', '.join(sorted(missing))}" if missing else None, "line": line}


def _from_headings(lines: list[str]) -> Iterator[dict]:
    open_section, thread, now, n = False, None, None, 0

    def closed() -> dict:
        return {"ordinal": n, "thread": thread, "date": now["date"], "title": now["title"], "body": "\n".join(now["body"]).strip(), "citation": "\n".join(now["cited"]).strip(), "line": now["line"]}

    cited = False
    for number, line in enumerate(lines, 1):
        if line == SECTION:
            open_section = True
        elif not open_section:
            continue
        elif line.startswith("## "):
            break
        elif match := THREAD.match(line):
            if now:
                yield closed()
            thread, now = match[1].strip(), None
        elif match := EPISODE.match(line):
            if now:
                yield closed()
            now, n, cited = {"date": match[1], "title": match[2], "body": [], "cited": [], "line": number}, n + 1, False
        elif now and (cited or line.startswith(CITATION)):
            cited = bool(line.strip())
            if cited:
                now["cited"].append(line)
        elif now:
            now["body"].append(line)
    if now:
        yield closed()


def episodes(text: str | None) -> Iterator[dict]:
    """Rows of COLUMNS for one text: its episodes, and what is wrong with its head."""
    if text is None:
        return
    lines, empty = text.split("\n"), dict.fromkeys(COLUMNS)
    if lines[0].strip() == "---" and (end := next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)):
        try:
            head = parse_head(list(enumerate(lines[1:end], 2)))
        except HeadError as e:
            yield empty | {"origin": "front_matter", "problem": e.what, "line": e.line}
        else:
            if isinstance(head, dict) and isinstance(head.get(LIST), list):
                line = next(i for i, x in enumerate(lines, 1) if x.strip().startswith(f"{LIST}:"))
                yield from (empty | e | {"origin": "front_matter"} for e in _from_head(head[LIST], line))
                return
    yield from (empty | e | {"origin": "headings"} for e in _from_headings(lines))


#: A task holds at most so many episodes before it hands them on (those of a head are read together).
HELD = 1000


def scanned(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    """Batches of (_id, _t) as batches of at most HELD rows (id, COLUMNS)."""
    kinds = [pa.int32() if t.endswith(" int") else pa.string() for t in TYPES.split(", ")]
    for batch in batches:
        ids, texts = batch.column("_id"), batch.column("_t")

        def rows(at: list, found: list, ids=ids) -> pa.RecordBatch:
            return pa.record_batch([ids.take(pa.array(at, pa.int64())), *(pa.array([e[c] for e in found], k) for c, k in zip(COLUMNS, kinds))], [id_col, *COLUMNS])

        at, found = [], []
        for i in range(batch.num_rows):
            for e in episodes(texts[i].as_py()):
                at.append(i)
                found.append(e)
                if len(found) == HELD:
                    yield rows(at, found)
                    at, found = [], []
        yield rows(at, found)


def scan_episodes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, COLUMNS): the episodes of each text and the problems of its head."""
    id_type = dict(rows.select(id_col).dtypes)[id_col]
    return small_batches(rows).selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _t").mapInArrow(lambda batches: scanned(batches, id_col), f"`{id_col}` {id_type}, {TYPES}")
