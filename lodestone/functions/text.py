"""Text functions: normalisation, slugs, entities, dates, topics, edit distance and token scores."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spanish month names.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
_ACCENTS, _PLAIN = "áéíóúüñàèìòùâêîôûäëïöçÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛÄËÏÖÇ", "aeiouunaeiouaeiouaeiocAEIOUUNAEIOUAEIOUAEIOC"


def collapse(text: Column) -> Column:
    """Soft hyphens out, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "­", ""), r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC, which has no built-in."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize_text(text: Column) -> Column:
    """NFC, then ``collapse``. Characters below U+0300 are NFC among themselves, so only texts with others go to Python."""
    marked = text.rlike(r"[^\x{0}-\x{2FF}]")
    return collapse(F.coalesce(nfc(F.when(marked, text)), text))


def fold_accents(text: Column) -> Column:
    return F.translate(text, _ACCENTS, _PLAIN)


def slug(text: Column, max_len: int = 80) -> Column:
    """Accents folded, lower case, other characters to single hyphens."""
    plain = F.regexp_replace(F.lower(fold_accents(text)), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(plain, r"^-+|-+$", ""), 1, max_len)


def accent_insensitive_pattern(text: str) -> str:
    """A pattern that matches ``text`` with any accents."""
    groups = {}
    for a, p in zip(_ACCENTS, _PLAIN):
        groups.setdefault(p.lower(), set()).update((a.lower(), p.lower()))
    out = []
    for c in text.lower():
        base = fold_char(c)
        out.append("[" + "".join(sorted(groups[base])) + "]" if base in groups else ("\\" + c if not c.isalnum() and not c.isspace() else c))
    return "(?iU)" + "".join(out)


def fold_char(c: str) -> str:
    at = _ACCENTS.find(c)
    return _PLAIN[at] if at >= 0 else c


def spanish_date(text: Column) -> Column:
    """'3 de mayo de 2024' to '2024-05-03'; '' when it is no such date."""
    pattern = r"(?i)(\d{1,2})\s+de\s+([a-záéíóú]+)\s+(?:de|del)\s+(\d{4})"
    month = F.create_map(*[x for k, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{k:02d}"))])
    got = F.try_element_at(month, F.lower(F.regexp_extract(text, pattern, 2)))
    day = F.lpad(F.regexp_extract(text, pattern, 1), 2, "0")
    return F.when(got.isNotNull(), F.concat_ws("-", F.regexp_extract(text, pattern, 3), got, day)).otherwise("")


def year_of(text: Column, low: int = 2000, high: int = 2030) -> Column:
    """The smallest year low..high that the text contains, null if none."""
    years = F.array(*[F.lit(y) for y in range(low, high + 1)])
    return F.get(F.filter(years, lambda y: F.contains(text, y.cast("string"))), F.lit(0))


def topics(text: Column, table: dict[str, list[str]]) -> Column:
    """Names of ``table`` with a keyword in the text, in the table's order."""
    low = F.lower(text)
    found = [F.when(_any(low, words), F.lit(name)) for name, words in table.items()]
    return F.array_compact(F.array(*found))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w.lower())
    return out


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def token_counts(text: Column) -> Column:
    """Lower-cased white-space tokens."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def runs(values: Column) -> Column:
    """(kinds, most) of an array without nulls: its different values and the count of the most frequent, from the runs of the sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(0).alias("kinds"))

    def step(s, v):
        same = s["last"].eqNullSafe(v)
        run = F.when(same, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(v.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"), F.when(same, s["kinds"]).otherwise(s["kinds"] + 1).alias("kinds"))

    return F.aggregate(F.sort_array(values), start, step, lambda s: F.struct(s["kinds"].cast("bigint").alias("kinds"), s["most"].cast("bigint").alias("most")))


def multiset_sizes(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, tokens, kinds, most) of each key with tokens: how many, how many different, the count of the most frequent.

    Tokens are counted inside the row and only the counts move; rows that share a key are counted word by word."""
    words = rows.select(key, token_counts(text).alias("_w"))
    counts = words.select(key, F.size("_w").cast("bigint").alias("tokens"), runs(F.col("_w")).alias("_r")).select(key, "tokens", "_r.*")
    alone = counts.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("tokens", "kinds", "most")]).where("_n = 1 and tokens > 0").drop("_n")
    shared = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")
    each = words.join(shared, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(key, F.explode("_w").alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    return alone.unionByName(each.groupBy(key).agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds"), F.max("n").alias("most")))


def char_error_rate(truth: Column, observed: Column) -> Column:
    return F.levenshtein(truth, observed) / F.greatest(F.length(truth), F.lit(1))


@F.pandas_udf(T.DoubleType())
def word_error_rate(truth: pd.Series, observed: pd.Series) -> pd.Series:
    """Edit distance over words, divided by the truth's words; words map to private characters first."""

    def one(a: str, b: str) -> float:
        x, y = (a or "").split(), (b or "").split()
        row = list(range(len(y) + 1))
        for i, w in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != v))
        return row[-1] / max(1, len(x))

    return pd.Series([one(a, b) for a, b in zip(truth, observed)])


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")]))
def token_prf(truth: pd.Series, observed: pd.Series) -> pd.DataFrame:
    """Multiset token precision, recall and F1."""

    def one(a: str, b: str) -> tuple[float, float, float]:
        x, y = Counter((a or "").lower().split()), Counter((b or "").lower().split())
        both = (x & y).total()
        p = both / y.total() if y else float(not x)
        r = both / x.total() if x else float(not y)
        return p, r, 2 * p * r / (p + r) if p + r else 0.0

    return pd.DataFrame([one(a, b) for a, b in zip(truth, observed)], columns=["precision", "recall", "f1"])


def span_recall(spans: Column, observed: Column) -> Column:
    """Share of required spans that occur, case folded; 1 for none required."""
    low = F.lower(observed)
    hit = F.size(F.filter(spans, lambda s: F.contains(low, F.lower(s))))
    return F.when(F.size(spans) == 0, 1.0).otherwise(hit / F.size(spans))


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def is_token(c: Column) -> Column:
    return c.rlike("^[a-z][a-z0-9_.-]*$")


def is_iso_date(c: Column) -> Column:
    """The shape YYYY-MM-DD; the date need not exist."""
    return c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def mentions(c: Column, terms: list[str]) -> Column:
    """Whether any term occurs, whatever its case."""
    out = F.lit(False)
    for t in terms:
        out = out | F.lower(c).contains(t.lower())
    return out


def mapped(c: Column, names: dict[str, str], default: str | None) -> Column:
    """A value's entry, whatever its case, else the default."""
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.upper(), v)])
    return F.coalesce(F.try_element_at(table, F.upper(c)), F.lit(default).cast("string"))


def route(c: Column, signals: dict[str, list[str]], stop: list[str]) -> Column:
    """The route most of whose signals occur, the first listed of equals; null if none does or a stop term occurs."""
    low = F.lower(c)
    count = lambda terms: sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))
    scored = F.array(*[F.struct(count(terms).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, terms) in enumerate(signals.items())])
    best = F.array_max(scored)
    return F.when(~mentions(c, stop) & (best["n"] > 0), best["name"])


def name_tokens(c: Column, stopwords: list[str], least: int = 4, most: int = 8) -> Column:
    """The first words of a name that have ``least`` letters and are no stopwords, lower-cased."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(stopwords))
    return F.slice(words, 1, most)


def bigrams(rows, c: Column):
    """One row (bigram) for each two neighbouring words of each text."""
    words = F.split(c, " ")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return rows.select(F.explode(F.when(F.size(words) > 1, pairs)).alias("bigram"))


def episode_key(*parts: Column) -> Column:
    """Parts with white space collapsed, joined by the unit separator."""
    return F.concat_ws("\x1f", *[F.trim(F.regexp_replace(p, r"\s+", " ")) for p in parts])


def markdown_sections(rows, id_col: str, c: Column):
    """(id, heading, position, line): the lines of each text under their last ``## `` heading; lines before the
    first heading have none and are left out."""
    from pyspark.sql import Window

    lines = rows.select(id_col, F.posexplode(F.split(c, "\n")).alias("position", "line"))
    head = F.when(F.col("line").startswith("## "), F.struct(F.col("position").alias("at"), F.col("line").substr(F.lit(4), F.length("line")).alias("heading")))
    under = F.last(head, ignorenulls=True).over(Window.partitionBy(id_col).orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    out = lines.withColumn("_h", under).where("_h is not null and position <> _h.at")
    return out.select(id_col, F.col("_h.at").alias("section"), F.col("_h.heading").alias("heading"), "position", "line")


def bulletin_items(c: Column, section: str) -> Column:
    """Items (date, title) of one ``## `` section's list: lines such as ``- 2024-05-01: Title``."""
    body = F.regexp_extract(c, f"(?s)(?:^|\n)## {section}\n(.*?)(?:\n## |$)", 1)
    items = F.regexp_extract_all(body, F.lit(r"(?m)^- ([0-9]{4}-[0-9]{2}-[0-9]{2}: [^\n]+)$"), F.lit(1))
    return F.transform(items, lambda x: F.struct(F.substring(x, 1, 10).alias("date"), F.substring(x, F.lit(13), F.length(x)).alias("title")))


def covered_cells(c: Column, cells: Column) -> Column:
    """Share of table cells found in a text, as often as they stand in the table and between word boundaries;
    1 for a table without cells."""
    quoted = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x, F.lit(r"\E(?![\p{L}\p{N}])"))
    found = lambda x: F.least(F.regexp_count(c, quoted(x)), F.size(F.filter(cells, lambda y: y == x)))
    got = F.aggregate(F.array_distinct(cells), F.lit(0), lambda n, x: n + found(x))
    return F.when(F.size(cells) == 0, 1.0).otherwise(got / F.size(cells))


def token_index(rows, id_col: str, c: Column):
    """(token, id): the inverted index of texts, each token once per text; bucket it by token when it is kept."""
    words = F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return rows.select(id_col, F.explode(words).alias("token")).distinct()


def search_index(index, id_col: str, terms: list[str]):
    """Ids whose texts hold all terms: one pass over the terms' postings."""
    terms = sorted({t.lower() for t in terms})
    hits = index.where(F.col("token").isin(terms)).groupBy(id_col).agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len(terms)).select(id_col)
