"""Registered queries over dictionaries, episodes, generated cases and reopened table ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dictionary, episodes
from .operators import cases, selectors
from .queries import C, query

# --- dictionaries

_PLAIN = "strip_accents(lower(coalesce({}, '')))"
_LIST = rf"""l AS (SELECT DISTINCT strip_accents(lower(w)) AS w FROM (SELECT unnest(string_split_regex(text, '[^\p{{L}}\p{{N}}]+')) AS w FROM benchmark) WHERE length(w) >= 5),
o AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex({_PLAIN.format("text")}, '[^\p{{L}}\p{{N}}]+')) AS w FROM documents) GROUP BY 1, 2)"""


def _terms(t) -> list[tuple[str, str]]:
    """All words of five letters or more of the benchmark (a bounded table), by their length."""
    words = t("benchmark").select(F.explode(F.split("text", r"[^\p{L}\p{N}]+")).alias("w")).where("length(w) >= 5").distinct()
    return sorted({(f"length {len(w)}", w) for w in {dictionary.folded(r["w"]) for r in words.collect()}})


@query(rf"WITH {_LIST} SELECT doc_id, w AS term, n FROM o JOIN l USING (w)")
def dictionary_terms(t):
    found = dictionary.find_terms(t("documents"), "doc_id", "text", _terms(t))
    return found.select("doc_id", "term", "n")


@query(rf"""WITH {_LIST}, h AS (SELECT doc_id, length(w) AS f, count(*) AS n FROM o JOIN l USING (w) GROUP BY 1, 2), s AS (SELECT doc_id FROM h WHERE f = 12)
SELECT doc_id, arg_max('length ' || f, n * 100 - f) FILTER (f <= 8) AS route, max(n) FILTER (f <= 8) AS score FROM h WHERE doc_id NOT IN (FROM s) GROUP BY doc_id HAVING count(*) FILTER (f <= 8) > 0""")
def dictionary_routes(t):
    """The length from 5 to 8 with most different words; a document with a word of twelve letters goes nowhere."""
    found = dictionary.find_terms(t("documents"), "doc_id", "text", _terms(t))
    return dictionary.routes(found, "doc_id", [f"length {n}" for n in range(5, 9)], "length 12").where("route is not null")


# --- episodes


@query("""SELECT client_id, strftime(coalesce(valid_at, TIMESTAMP '2024-01-01'), '%Y-%m-%d') AS date, 'Change ' || change_id AS title, 'To: ' || coalesce(city, '-') AS body, '> Fuente: ' || coalesce(source, '-') AS citation,
CASE WHEN client_id % 2 = 0 THEN 'front_matter' ELSE 'headings' END AS origin FROM client_changes WHERE client_id IS NOT NULL""")
def episode_scan(t):
    """Each client's changes as a record, every other one with a head, and read again."""
    date = F.date_format(F.coalesce("valid_at", F.lit("2024-01-01").cast("timestamp")), "yyyy-MM-dd")
    said = lambda c: F.coalesce(c, F.lit("-"))
    head = F.concat(F.lit("  - hilo_destino: "), F.lit("clients\n    fecha: "), date, F.lit('\n    titulo: "Change '), C("change_id").cast("string"), F.lit("\"\n    cuerpo: 'To: "), F.replace(said("city"), F.lit("'"), F.lit("''")), F.lit("'\n    cita: "), said("source"))
    body = F.concat(F.lit("#### "), date, F.lit(" — Change "), C("change_id").cast("string"), F.lit("\n\nTo: "), said("city"), F.lit("\n\n> Fuente: "), said("source"), F.lit("\n"))
    whole = t("client_changes").where("client_id is not null").groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("change_id", head.alias("h"), body.alias("b")))).alias("r"))
    listed = lambda c: F.transform("r", lambda x: x[c])
    text = F.when(C("client_id") % 2 == 0, F.concat(F.lit("---\nkind: record\nepisodios:\n"), F.array_join(listed("h"), "\n"), F.lit("\n---\n# Not read\n"))).otherwise(
        F.concat(F.lit("intro\n## Episodios\n### → Hilo: `clients`\n"), F.array_join(listed("b"), "\n"), F.lit("\n## Other\n#### 2024-01-01 — not this\n"))
    )
    got = episodes.scan_episodes(whole.select("client_id", text.alias("text")), "client_id", "text")
    return got.where("problem is null").select("client_id", "date", "title", "body", "citation", "origin")


# --- generated cases

_CELLS = "c AS (SELECT brand AS t, 'size' AS col, size::DECIMAL(28,4) AS v FROM items UNION ALL SELECT brand, 'price', price::DECIMAL(28,4) FROM items)"


@query(f"""WITH {_CELLS}, k AS (SELECT t, col, sum(v)::DECIMAL(28,4) AS total FROM c WHERE v IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2),
p AS (SELECT k.*, i, (total + i * CASE WHEN total = floor(total) THEN 1 ELSE 0.01 END)::DECIMAL(28,4) AS w FROM k, (SELECT unnest(range(1, 9)) AS i)),
f AS (SELECT t, col, arg_min(w, i) AS w FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.t = p.t AND c.v = p.w) GROUP BY 1, 2)
SELECT t AS brand, col AS column, total::DOUBLE AS total, w::DOUBLE AS false_total FROM k JOIN f USING (t, col)""")
def counterfactual_cases(t):
    return cases.counterfactual(cases.sums(_cells(t)), _cells(t)).select(C("table").alias("brand"), "column", C("total").cast("double").alias("total"), C("false_total").cast("double").alias("false_total"))


def _cells(t):
    one = lambda c: F.struct(F.lit(c).alias("column"), C(c).cast("decimal(28,4)").alias("value"))
    return t("items").where("brand is not null").select(C("brand").alias("table"), F.explode(F.array(one("size"), one("price"))).alias("c")).select("table", "c.*")


@query("""WITH b AS (SELECT DISTINCT brand FROM items WHERE brand IS NOT NULL), n AS (SELECT brand, (count(size) > 0)::INT + (count(price) > 0)::INT AS cols FROM items WHERE brand IS NOT NULL GROUP BY brand), s AS (SELECT brand, 'absent-' || sha256('seed' || chr(10) || brand || chr(10) || '0')[1:16] AS x FROM b)
SELECT brand, relation, (CASE relation WHEN 'absent' THEN 1 ELSE cols END)::BIGINT AS n, CASE relation WHEN 'absent' THEN x END AS sentinel FROM n JOIN s USING (brand), (SELECT unnest(['supported', 'contradicted', 'absent']) AS relation) WHERE relation = 'absent' OR cols > 0""")
def generated_cases(t):
    texts = t("items").select(C("brand").alias("table"), C("name").alias("text"))
    built = cases.build(_cells(t), texts, "seed")
    return built.groupBy(C("table").alias("brand"), "relation").agg(F.count("*").alias("n"), F.max(F.when(C("relation") == "absent", C("value"))).alias("sentinel"))


# --- table ranges


@query("""WITH r AS (SELECT sale_id, item_id, quantity, row_number() OVER w AS rn, count(*) OVER (PARTITION BY sale_id) AS n FROM sale_lines WHERE sale_id IS NOT NULL WINDOW w AS (PARTITION BY sale_id ORDER BY line_no, item_id, vendor_id, quantity, amount, shipped_at)),
o AS (SELECT sale_id, any_value(n) AS n, max(CASE WHEN rn = 2 THEN quantity END) IS DISTINCT FROM max(CASE WHEN rn = 3 THEN quantity END) AS differ FROM r GROUP BY sale_id)
SELECT sale_id, CASE WHEN sale_id % 4 = 3 THEN 'sheet_not_unique' WHEN sale_id % 4 = 2 THEN 'bounds_disagree' WHEN n < 3 THEN 'range_outside' WHEN sale_id % 4 = 1 AND differ THEN 'values_differ' END AS problem FROM o""")
def table_range_observed(t):
    """Rows 2 and 3 of each sale's lines, cited as they are, turned round, with other bounds, or on a sheet named twice."""
    keys = ["line_no", "item_id", "vendor_id", "quantity", "amount", "shipped_at"]
    # nulls stand last, as in the order of the lines
    order = [F.struct(C(k).isNull(), C(k)).alias(k) for k in keys]
    lines = t("sale_lines").where("sale_id is not null").groupBy("sale_id").agg(F.array_sort(F.collect_list(F.struct(*order, C("quantity").alias("q")))).alias("r"))
    rows = F.transform("r", lambda x: F.array(x["line_no"]["line_no"].cast("string"), x["q"].cast("string")))
    kind = C("sale_id") % 4
    seen = F.array(F.array(F.get(F.get(rows, F.lit(1)), F.lit(1))), F.array(F.get(F.get(rows, F.lit(2)), F.lit(1))))
    turned = F.when(kind == 1, F.reverse(seen)).otherwise(seen)
    sheets = F.array(F.struct(F.lit("lines").alias("name"), rows.alias("rows")), F.struct(F.when(kind == 3, "lines").otherwise("other").alias("name"), F.array().cast("array<array<string>>").alias("rows")))
    problem = selectors.range_problem(sheets, F.lit("lines"), F.lit("B2:B3"), F.when(kind == 2, 1).otherwise(2), F.lit(3), turned)
    return lines.select("sale_id", problem.alias("problem"))
