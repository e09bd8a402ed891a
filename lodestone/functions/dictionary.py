"""Dictionaries of terms over texts: all terms of all families in one pass.

The terms become one Aho-Corasick automaton, built once, broadcast, and run over each text in the tasks, so thousands
of terms cost what one does. A term counts where neither neighbour is a letter or digit, whatever its case and
accents. Topics, personal-data terms, categories and routes are then aggregates of what was found.

* Terms that fold to the same text are found together; a term that folds to nothing, or begins or ends with other
  than a letter or digit, is refused. Occurrences may overlap.
* Null and empty texts hold nothing. Rows that repeat an id are counted together.
* A dictionary is bounded: at most MOST characters of terms (checked), as every task holds the automaton.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 20_000_000


def folded(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def compiled(terms: list[tuple[str, str]]) -> ahocorasick.Automaton:
    """The automaton of (family, term) pairs: each folded term with the pairs it stands for."""
    if sum(len(t) for _, t in terms) > MOST:
        raise ValueError(f"a dictionary has at most {MOST} characters of terms")
    by_text: dict[str, list[tuple[str, str]]] = {}
    for family, term in sorted(set(terms)):
        text = folded(term)
        if not text or not (text[0].isalnum() and text[-1].isalnum()):
            raise ValueError(f"the term {term!r} does not begin and end with a letter or digit")
        by_text.setdefault(text, []).append((family, term))
    automaton = ahocorasick.Automaton()
    for text, pairs in by_text.items():
        automaton.add_word(text, (len(text), pairs))
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton, text: str) -> Iterator[tuple[str, str, int]]:
    """(family, term, end in the folded text) of each occurrence between word boundaries."""
    folded_text = folded(text)
    for end, (length, pairs) in automaton.iter(folded_text):
        before, after = end - length, end + 1
        if (before < 0 or not folded_text[before].isalnum()) and (after >= len(folded_text) or not folded_text[after].isalnum()):
            for family, term in pairs:
                yield family, term, end


def find_terms(rows: DataFrame, id_col: str, text_col: str, terms: list[tuple[str, str]]) -> DataFrame:
    """(id, family, term, n): how often each text holds each term."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(compiled(terms)) if terms else None
    id_type = dict(rows.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, family, term, n = [], [], [], []
            for i, text in enumerate(batch.column("_t").to_pylist()):
                counts: dict[tuple[str, str], int] = {}
                for f, t, _ in occurrences(shared.value, text) if text and shared else ():
                    counts[f, t] = counts.get((f, t), 0) + 1
                for (f, t), k in counts.items():
                    for column, value in zip((at, family, term, n), (i, f, t, k)):
                        column.append(value)
            ids = batch.column("_id").take(pa.array(at, pa.int64()))
            yield pa.record_batch([ids, pa.array(family, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int64())], [id_col, "family", "term", "n"])

    found = rows.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _t").mapInArrow(run, f"`{id_col}` {id_type}, family string, term string, n bigint")
    return found.groupBy(id_col, "family", "term").agg(F.sum("n").alias("n"))


def topics(found: DataFrame, id_col: str) -> DataFrame:
    """(id, topics): the families that a text holds terms of, sorted."""
    return found.groupBy(id_col).agg(F.array_sort(F.collect_set("family")).alias("topics"))


def routes(found: DataFrame, id_col: str, order: list[str], stop: str) -> DataFrame:
    """(id, route, score): the family with most different terms, the first of ``order`` among equals; a text that
    holds any term of the family ``stop`` has none."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("family"))
    per = found.groupBy(id_col, "family").agg(F.count("*").alias("terms"))
    best = F.max(F.when(place > 0, F.struct(F.col("terms").alias("score"), (-place).alias("place"), F.col("family").alias("route"))))
    return per.groupBy(id_col).agg(best.alias("b"), F.bool_or(F.col("family") == stop).alias("stopped")).select(id_col, F.when(~F.col("stopped"), F.col("b.route")).alias("route"), F.when(~F.col("stopped"), F.col("b.score")).alias("score"))


def _values(text: Column, family: str, pattern: str, template: str) -> Column:
    before, _, after = template.partition("{n}")
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(family).alias("family"), F.concat(F.lit(before), v, F.lit(after)).alias("value")))


def extracted(text: Column, patterns: dict[str, list[tuple[str, str]]]) -> Column:
    """Distinct (family, value) of all matches of each family's (pattern, template); ``{n}`` in a template stands for
    the first group. Evaluated in the JVM."""
    out = None
    for family, forms in patterns.items():
        for pattern, template in forms:
            values = _values(text, family, pattern, template)
            out = values if out is None else F.concat(out, values)
    return F.array_sort(F.array_distinct(out))
