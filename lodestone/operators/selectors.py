"""Selectors: pointers into retained sources. Validation, containment and reopening, as column expressions.

A selector is a JSON object of one kind. Reopening tests that it still finds in the source what it was made
from; containment tells whether one selector's scope lies inside another's, and says no where that is not certain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Required and optional keys by selector kind.
KEYS = {
    "whole": ((), ()),
    "pdf_page": (("page_ordinal",), ()),
    "pdf_page_quote": (("page_ordinal", "exact"), ("prefix", "suffix")),
    "text_quote": (("exact",), ("start_char", "end_char", "prefix", "suffix")),
    "table_range": ((), ("sheet", "table_name", "a1_range", "row_start", "row_end", "headers", "observed_values")),
    "media": (("media_sha256", "duration_us", "start_us", "end_us"), ()),
}
A1 = r"^([A-Z]{1,3})([1-9][0-9]*)(?::([A-Z]{1,3})([1-9][0-9]*))?$"


def _text(c) -> Column:
    return F.lit(c) if not isinstance(c, Column) else c


def field(selector: Column, key: str, kind: str = "string") -> Column:
    return F.get_json_object(selector, f"$.{key}").try_cast(kind)


def selector_problem(kind: Column, selector: Column) -> Column:
    """Null for a valid selector, else unknown_kind, not_an_object, missing_key, unknown_key or bad_value."""
    keys = F.json_object_keys(selector)
    names = lambda x: F.array(*[F.lit(k) for k in x]).cast("array<string>")
    required = reduce(lambda out, k: F.when(kind == k, names(KEYS[k][0])).otherwise(out), KEYS, F.lit(None).cast("array<string>"))
    known = reduce(lambda out, k: F.when(kind == k, names(KEYS[k][0] + KEYS[k][1])).otherwise(out), KEYS, F.lit(None).cast("array<string>"))
    number = lambda k: field(selector, k, "bigint")
    has = lambda k: F.array_contains(keys, k)
    bad = F.lit(False)
    for key, least in (("page_ordinal", 1), ("start_char", 0), ("row_start", 1), ("start_us", 0), ("duration_us", 1)):
        bad = bad | (has(key) & ~F.coalesce(number(key) >= least, F.lit(False)))
    for first, last, strict in (("start_char", "end_char", True), ("row_start", "row_end", False), ("start_us", "end_us", True)):
        in_order = number(first) < number(last) if strict else number(first) <= number(last)
        bad = bad | (has(first) != has(last)) | (has(first) & ~F.coalesce(in_order, F.lit(False)))
    bad = bad | (has("end_us") & ~F.coalesce(number("end_us") <= number("duration_us"), F.lit(False)))
    bad = bad | (has("exact") & (F.coalesce(field(selector, "exact"), F.lit("")) == ""))
    bad = bad | (has("media_sha256") & ~F.coalesce(field(selector, "media_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)))
    bad = bad | (has("a1_range") & a1_bounds(field(selector, "a1_range")).isNull())
    return (
        F.when(required.isNull(), "unknown_kind")
        .when(keys.isNull(), "not_an_object")
        .when(F.size(F.array_except(required, keys)) > 0, "missing_key")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown_key")
        .when(bad, "bad_value")
    )


def canonical(selector: Column) -> Column:
    """A flat JSON object with sorted keys and no white space; values keep their own text."""
    entries = F.array_sort(F.map_entries(F.from_json(selector, "map<string,string>")))
    quoted = lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, quoted), ","), F.lit("}"))


def column_number(letters: Column) -> Column:
    """Spreadsheet column letters as a number: A is 1, Z 26, AA 27."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def column_letters(number: Column) -> Column:
    """The letters of a spreadsheet column, as ``column_number`` reads them: 1 to 18278 (ZZZ), null beyond."""
    letter = lambda n: F.chr(65 + F.pmod(n, F.lit(26)))
    n = number.cast("bigint") - 1
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    letters = F.concat(F.when(three >= 0, letter(three)).otherwise(""), F.when(two >= 0, letter(two)).otherwise(""), letter(n))
    return F.when((n >= 0) & (n < 26 + 26**2 + 26**3), letters)


def a1_bounds(a1: Column) -> Column:
    """(min_col, min_row, max_col, max_row) of a range such as B2:D7 or B2; null if it is none or runs backwards."""
    # arrays of one element bind each step, so that none is worked out again where it is used twice
    parts = F.transform(F.filter(F.array(a1), lambda x: x.rlike(A1)), lambda x: F.array(*[F.regexp_extract(x, A1, k) for k in range(1, 5)]))
    last = lambda p, k: F.coalesce(F.nullif(p[k + 2], F.lit("")), p[k])
    column, row = lambda x, name: column_number(x).alias(name), lambda x, name: x.try_cast("bigint").alias(name)
    bounds = F.transform(parts, lambda p: F.struct(column(p[0], "min_col"), row(p[1], "min_row"), column(last(p, 0), "max_col"), row(last(p, 1), "max_row")))
    return F.get(F.filter(bounds, lambda b: (b["min_col"] <= b["max_col"]) & (b["min_row"] <= b["max_row"])), F.lit(0))


def _inside(o: Column, i: Column) -> Column:
    inside = (o["min_col"] <= i["min_col"]) & (o["min_row"] <= i["min_row"]) & (o["max_col"] >= i["max_col"]) & (o["max_row"] >= i["max_row"])
    return F.coalesce(inside, F.lit(False))


def rect_contains(outer: Column, inner: Column) -> Column:
    """Whether A1 range ``outer`` holds ``inner``; false where either is no range."""
    return _inside(a1_bounds(outer), a1_bounds(inner))


def scope(kind: Column, selector: Column) -> Column:
    """What ``within`` asks of a selector, read from its JSON: a selector that meets many others is read once."""
    of = lambda value, *kinds: F.when(kind.isin(*kinds), value)
    # a text without the letters of a key (or an escape, which could stand for them) is not searched for it
    get = lambda k, t="string": F.when(selector.contains(k) | selector.contains("\\"), field(selector, k, t))
    numbers = lambda k, *keys: [of(get(x, "bigint"), k).alias(x) for x in keys]
    start = field(selector, "start_char", "bigint")
    # bounds without values: a range is given, but is none
    no_range = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("min_col", "int"), ("min_row", "bigint"), ("max_col", "int"), ("max_row", "bigint"))])
    bounds = F.get(F.transform(F.filter(F.array(field(selector, "a1_range")), lambda x: x.isNotNull()), lambda x: F.coalesce(a1_bounds(x), no_range)), F.lit(0))
    # where offsets decide, the text does not
    whole = F.when((kind == "pdf_page_quote") | start.isNull(), canonical(selector))
    return F.struct(
        of(get("page_ordinal", "bigint"), "pdf_page", "pdf_page_quote").alias("page_ordinal"), of(whole, "pdf_page_quote", "text_quote").alias("text"),
        of(start, "text_quote").alias("start_char"), of(field(selector, "end_char", "bigint"), "text_quote").alias("end_char"),
        of(field(selector, "sheet"), "table_range").alias("sheet"), of(get("table_name"), "table_range").alias("table_name"), of(bounds, "table_range").alias("bounds"),
        of(F.coalesce(get("row_start").isNotNull(), F.lit(False)), "table_range").alias("lined"), *numbers("table_range", "row_start", "row_end"),
        of(get("media_sha256"), "media").alias("media_sha256"), *numbers("media", "duration_us", "start_us", "end_us"),
    )


def within(outer_kind: Column, outer: Column, inner_kind: Column, inner: Column) -> Column:
    """``contains`` of two selectors by their scopes."""
    same = lambda k: F.coalesce(outer[k] == inner[k], F.lit(False))
    spans = lambda a, b: F.coalesce((outer[a] <= inner[a]) & (outer[b] >= inner[b]), F.lit(False))
    ranged, lined = outer["bounds"].isNotNull(), outer["lined"]
    table = (
        (outer["sheet"].isNull() | same("sheet")) & (outer["table_name"].isNull() | same("table_name"))
        & (~ranged | _inside(outer["bounds"], inner["bounds"]))
        & (~lined | spans("row_start", "row_end"))
        & (outer["sheet"].isNotNull() | outer["table_name"].isNotNull() | ranged | lined)
    )
    offsets = outer["start_char"].isNotNull() & inner["start_char"].isNotNull()
    of_kind = (
        F.when(outer_kind == "whole", F.lit(True))
        .when(outer_kind == "pdf_page", inner_kind.isin("pdf_page", "pdf_page_quote") & same("page_ordinal"))
        .when(outer_kind != inner_kind, F.lit(False))
        .when(outer_kind == "pdf_page_quote", same("text"))
        .when(outer_kind == "text_quote", F.when(offsets, spans("start_char", "end_char")).otherwise(same("text")))
        .when(outer_kind == "table_range", table)
        .when(outer_kind == "media", same("media_sha256") & same("duration_us") & spans("start_us", "end_us"))
    )
    return F.coalesce(of_kind, F.lit(False))


def contains(outer_kind: Column, outer: Column, inner_kind: Column, inner: Column) -> Column:
    """Whether the inner selector's scope is certain to lie in the outer one's, on one representation."""
    return within(outer_kind, scope(outer_kind, outer), inner_kind, scope(inner_kind, inner))


def _literal(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, exact: Column, prefix: Column, suffix: Column) -> Column:
    """Places where ``exact`` stands between ``prefix`` and ``suffix``; overlapping ones count."""
    pattern = F.concat(F.lit("(?s)(?<="), _literal(prefix), F.lit(")(?="), _literal(F.concat(exact, suffix)), F.lit(")"))
    return F.regexp_count(text, pattern)


def quote_problem(text: Column, exact: Column, start: Column | None = None, end: Column | None = None, prefix=None, suffix=None) -> Column:
    """Null if the quote reopens: with offsets, exactly there and between prefix and suffix; without, exactly once."""
    prefix, suffix = (F.coalesce(_text(x), F.lit("")) if x is not None else F.lit("") for x in (prefix, suffix))
    if start is None:
        return F.when(occurrences(text, exact, prefix, suffix) != 1, "not_unique")
    found = F.substring(text, start + 1, end - start)
    return (
        F.when((end > F.length(text)) | (found != exact), "offsets")
        .when(~F.substring(text, F.lit(1), start).endswith(prefix), "prefix")
        .when(~F.substring(text, end + 1, F.length(text)).startswith(suffix), "suffix")
    )


def table_slice(rows: Column, a1: Column) -> Column:
    """Cells of an array of rows inside an A1 range; what lies beyond the table is left out."""
    b = a1_bounds(a1)
    cut = lambda x, lo, hi: F.slice(x, lo.cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int"))
    return F.transform(cut(rows, b["min_row"], b["max_row"]), lambda r: cut(r, b["min_col"], b["max_col"]))


def range_problem(sheets: Column, sheet: Column, a1: Column, row_start: Column, row_end: Column, observed: Column) -> Column:
    """Null if a cited table range reopens: one sheet has the name, the row bounds are those of the A1 range, the
    range lies in the sheet, and its cells are the observed values. ``sheets``: array of (name, rows of cells)."""
    named = F.filter(sheets, lambda s: s["name"] == sheet)
    bounds, rows = a1_bounds(a1), F.get(named, F.lit(0))["rows"]
    return (
        F.when(F.coalesce(F.size(named), F.lit(0)) != 1, "sheet_not_unique")
        .when(bounds.isNull(), "bad_range")
        .when(~F.coalesce((bounds["min_row"] == row_start) & (bounds["max_row"] == row_end), F.lit(False)), "bounds_disagree")
        .when((F.size(rows) < row_end) | F.exists(table_slice(rows, a1), lambda r: F.size(r) < bounds["max_col"] - bounds["min_col"] + 1), "range_outside")
        .when(~table_slice(rows, a1).eqNullSafe(observed), "values_differ")
    )


def media_problem(source: Column, digest: Column, duration: Column, start: Column, end: Column) -> Column:
    """Null if a media span lies in its duration and points at these bytes."""
    inside = (duration > 0) & (start >= 0) & (end > start) & (end <= duration)
    return F.when(~F.coalesce(inside, F.lit(False)), "span").when(~F.coalesce(F.sha2(source, 256) == digest, F.lit(False)), "bytes")


def row_in_ranges(row: Column, ranges: Column) -> Column:
    """Whether a row number lies in any of an array of merged A1 ranges."""
    return F.exists(ranges, lambda a: F.coalesce((a1_bounds(a)["min_row"] <= row) & (row <= a1_bounds(a)["max_row"]), F.lit(False)))
