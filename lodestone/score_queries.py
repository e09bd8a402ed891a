"""Registered queries over candidate scores, capability gates, table statistics, listings, boards and routing tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import listing
from .operators import scoring
from .queries import C, query

# --- scores

_CANDIDATES = """t AS (SELECT o_orderkey AS truth, CASE o_orderpriority WHEN '1-URGENT' THEN 'must' WHEN '2-HIGH' THEN 'material' ELSE 'context' END AS importance FROM orders),
c AS (SELECT l_orderkey AS k, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'correct' WHEN 'RF' THEN 'distorted' WHEN 'NF' THEN 'redundant' WHEN 'NO' THEN 'overmerged' ELSE 'unsupported' END AS verdict FROM lineitem)"""


def _candidates(t):
    importance = F.when(C("o_orderpriority") == "1-URGENT", "must").when(C("o_orderpriority") == "2-HIGH", "material").otherwise("context")
    flag = F.concat("l_returnflag", "l_linestatus")
    verdict = F.when(flag == "AF", "correct").when(flag == "RF", "distorted").when(flag == "NF", "redundant").when(flag == "NO", "overmerged").otherwise("unsupported")
    truths = F.when(verdict == "overmerged", F.array(C("l_orderkey"), C("l_orderkey") + 1)).when(verdict == "unsupported", F.array().cast("array<bigint>")).otherwise(F.array("l_orderkey"))
    candidate = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("candidate")
    return t("orders").select(C("o_orderkey").alias("truth"), importance.alias("importance")), t("lineitem").select(candidate, verdict.alias("verdict"), truths.alias("truths"))


@query(f"""WITH {_CANDIDATES}, d AS (SELECT importance, count(*) AS n, count(*) FILTER (truth IN (SELECT k FROM c WHERE verdict = 'correct')) AS k FROM t GROUP BY 1)
SELECT (SELECT count(*) FROM t) AS truths, count(*) AS candidates, (SELECT k / n::DOUBLE FROM d WHERE importance = 'must') AS must_recall, (SELECT k / n::DOUBLE FROM d WHERE importance = 'material') AS material_recall, avg((verdict = 'correct')::INT) AS precision,
avg((verdict = 'unsupported')::INT) AS unsupported_rate, avg((verdict = 'redundant')::INT) AS redundant_rate, avg((verdict = 'overmerged')::INT) AS overmerge_rate, avg((verdict = 'distorted')::INT) AS distorted_rate FROM c""")
def candidate_metrics(t):
    return scoring.candidate_metrics(*_candidates(t))


@query(f"""WITH {_CANDIDATES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'unknown_truth' AS problem FROM lineitem WHERE l_returnflag || l_linestatus = 'NO' AND l_orderkey + 1 NOT IN (SELECT truth FROM t)""")
def candidate_problems(t):
    truths, candidates = _candidates(t)
    return scoring.candidate_problems(candidates, truths).select("candidate.*", "problem")


@query("""WITH c AS (SELECT s.sale_id, CASE status WHEN 'done' THEN 'supported' WHEN 'open' THEN 'insufficient_evidence' ELSE 'contradicted' END AS expected, CASE WHEN priority >= 4 THEN 'insufficient_evidence' WHEN total > 50 THEN 'supported' ELSE 'contradicted' END AS given,
list_sort(coalesce(n.items, [])) AS needed, coalesce(n.cited, []) AS cited FROM (SELECT DISTINCT sale_id, status, priority, total FROM sales) s LEFT JOIN (SELECT sale_id, list(DISTINCT item_id) FILTER (flag = 'kept' AND item_id IS NOT NULL) AS items, list(DISTINCT item_id) FILTER (quantity > 5 AND item_id IS NOT NULL) AS cited FROM sale_lines GROUP BY sale_id) n ON n.sale_id = s.sale_id)
SELECT count(*) AS n, count(*) FILTER (expected = given) / count(*)::DOUBLE AS accuracy, sum(len(list_intersect(needed, cited))) / sum(len(needed))::DOUBLE AS evidence_recall,
count(*) FILTER (expected = given AND given = 'insufficient_evidence') / (count(*) FILTER (given = 'insufficient_evidence'))::DOUBLE AS abstention_precision, count(*) FILTER (expected = given AND given = 'insufficient_evidence') / (count(*) FILTER (expected = 'insufficient_evidence'))::DOUBLE AS abstention_recall FROM c""")
def verdict_evidence_scores(t):
    expected = F.when(C("status") == "done", "supported").when(C("status") == "open", "insufficient_evidence").otherwise("contradicted")
    given = F.when(C("priority") >= 4, "insufficient_evidence").when(C("total") > 50, "supported").otherwise("contradicted")
    lines = t("sale_lines").groupBy(C("sale_id").alias("k")).agg(F.collect_set(F.when(C("flag") == "kept", C("item_id"))).alias("needed"), F.collect_set(F.when(C("quantity") > 5, C("item_id"))).alias("cited"))
    cases = t("sales").select("sale_id", "status", "priority", "total").distinct().join(lines, C("sale_id") == C("k"), "left")
    return scoring.verdict_scores(cases.select(expected.alias("expected"), given.alias("given"), "needed", "cited"))


@query("""WITH e AS (SELECT unnest([source, 'city ' || city]) AS capability, op, seq, balance, segment FROM client_changes),
g AS (SELECT capability, bool_or(op = 'D') AS failed, bool_or(op = 'I') AS passed, bool_or(balance > 4000) AS scope, bool_or(balance > 4000 AND seq > 0) AS gold, bool_or(balance > 4000 AND seq > 0 AND segment = 'public') AS ready,
bool_or(balance > 4000 AND seq > 0 AND segment = 'public' AND op = 'D') AS bad, bool_or(balance > 4000 AND seq > 0 AND segment = 'public' AND op = 'U') AS good FROM e WHERE capability IS NOT NULL GROUP BY capability),
r AS (SELECT DISTINCT source AS capability, 'deterministic' AS mode FROM clients WHERE source IS NOT NULL UNION SELECT DISTINCT 'city ' || city, 'semantic_gold' FROM clients WHERE city IS NOT NULL)
SELECT r.capability, mode, CASE WHEN g.capability IS NULL THEN 'missing' WHEN mode = 'deterministic' THEN CASE WHEN failed THEN 'failed' WHEN passed THEN 'verified' ELSE 'pending' END
WHEN NOT coalesce(scope, false) THEN 'gold_scope_pending' WHEN NOT coalesce(gold, false) THEN 'gold_pending' WHEN NOT coalesce(ready, false) THEN 'adjudication_pending' WHEN bad THEN 'failed' WHEN good THEN 'verified' ELSE 'evaluation_pending' END AS state FROM r LEFT JOIN g USING (capability)""")
def capability_states(t):
    clients = t("clients")
    required = clients.where("source is not null").select(C("source").alias("capability"), F.lit("deterministic").alias("mode")).distinct()
    required = required.unionByName(clients.where("city is not null").select(F.concat(F.lit("city "), C("city")).alias("capability"), F.lit("semantic_gold").alias("mode")).distinct())
    result = F.when(C("op") == "D", "failed").when(C("op") == "I", "passed")
    evaluation = F.when(C("op") == "D", "failed").when(C("op") == "U", "passed")
    cases = t("client_changes").select(
        F.array_compact(F.array(C("source"), F.concat(F.lit("city "), C("city")))).alias("covers"), result.alias("check"), (C("balance") > 4000).alias("scope_frozen"), (C("seq") > 0).alias("gold_frozen"),
        (C("segment") == "public").alias("adjudicated"), evaluation.alias("evaluation"), F.sha2(C("change_id").cast("string"), 256).alias("digest"),
    )
    return scoring.capability_states(required, cases)


# --- tables as workbooks

_ITEM_CELLS = "SELECT brand AS file, kind AS sheet, item_id, unnest([name, size::VARCHAR, price::VARCHAR]) AS v, unnest(['string', 'integer', 'number']) AS k FROM items WHERE brand IS NOT NULL AND kind IS NOT NULL"


@query(f"""WITH c AS ({_ITEM_CELLS}), p AS (SELECT file, sheet, count(*) // 3 AS rows, count(*) AS cells, count(v) AS filled FROM c GROUP BY 1, 2)
SELECT p.file, count(*) AS sheets, sum(rows)::BIGINT AS rows, sum(cells)::BIGINT AS cells, sum(filled)::BIGINT AS non_empty, 0::BIGINT AS formulas, (SELECT count(*) FROM items i WHERE i.brand = p.file AND i.size > 40) AS merged_ranges,
(SELECT string_agg(DISTINCT CASE WHEN v IS NULL THEN 'blank' ELSE k END, ';' ORDER BY CASE WHEN v IS NULL THEN 'blank' ELSE k END) FROM c WHERE c.file = p.file) AS kinds FROM p GROUP BY p.file""")
def cell_statistics(t):
    """Items as workbooks: one a brand, a sheet a kind, a row an item."""
    items = t("items").where("brand is not null and kind is not null")
    cell = lambda c, kind: F.when(C(c).isNull(), "blank").otherwise(kind)
    # rows of a sheet are numbered from 1
    numbered = items.withColumn("row", F.row_number().over(Window.partitionBy("brand", "kind").orderBy("item_id")))
    cells = numbered.select(C("brand").alias("file"), C("kind").alias("sheet"), "row", F.explode(F.array(cell("name", "string"), cell("size", "integer"), cell("price", "number"))).alias("k")).withColumnRenamed("k", "kind")
    got = scoring.cell_statistics(cells, t("items").where("size > 40").select(C("brand").alias("file")))
    return got.withColumn("kinds", F.array_join("kinds", ";"))


@query("""SELECT item_id, CASE WHEN size IS NULL THEN 'blank' ELSE 'integer' END AS c1_kind, size::VARCHAR AS c1_text, size::BIGINT AS c1_integer, size::DOUBLE AS c1_number, NULL::INTEGER AS c1_boolean, NULL::VARCHAR AS c1_datetime, NULL::VARCHAR AS c1_formula, 'A' || item_id AS c1_address, 'n' AS c1_data_type, '0' AS c1_number_format,
CASE WHEN price IS NULL THEN 'blank' ELSE 'boolean' END AS c2_kind, (price > 100)::VARCHAR AS c2_text, NULL::BIGINT AS c2_integer, NULL::DOUBLE AS c2_number, (price > 100)::INTEGER AS c2_boolean, NULL::VARCHAR AS c2_datetime, NULL::VARCHAR AS c2_formula, 'B' || item_id AS c2_address, 'b' AS c2_data_type, 'General' AS c2_number_format FROM items""")
def facet_columns(t):
    at = lambda letter, kind, form: {"address": F.concat(F.lit(letter), C("item_id").cast("string")), "data_type": F.lit(kind), "number_format": F.lit(form)}
    size = scoring.facet_columns(F.when(C("size").isNull(), "blank").otherwise("integer"), C("size"), at("A", "n", "0"), "c1")
    dear = scoring.facet_columns(F.when(C("price").isNull(), "blank").otherwise("boolean"), C("price") > 100, at("B", "b", "General"), "c2")
    return t("items").select("item_id", *size, *dear)


@query("""WITH r AS (SELECT sale_id, flag, quantity, discount, row_number() OVER (PARTITION BY sale_id ORDER BY line_no, item_id, vendor_id, quantity, amount, discount, flag, shipped_at) AS rn FROM sale_lines WHERE sale_id IS NOT NULL)
SELECT sale_id || ':R' || rn AS unit_id, (flag IS NOT NULL)::INTEGER + (quantity IS NOT NULL)::INTEGER + (discount IS NOT NULL)::INTEGER AS non_empty,
array_to_string(list_sort(list_filter([CASE WHEN flag IS NOT NULL THEN CASE flag WHEN 'kept' THEN 'string' ELSE 'formula' END END, CASE WHEN quantity IS NOT NULL THEN 'integer' END, CASE WHEN discount IS NOT NULL THEN 'number' END], lambda x: x IS NOT NULL)), ';') AS signature,
coalesce(flag <> 'kept', false) AS formula, rn BETWEEN 2 AND 4 OR rn = 7 AS merged FROM r""")
def row_units(t):
    """Each sale's lines as a sheet with two merged ranges; a flag other than kept counts as a formula."""
    keys = ["line_no", "item_id", "vendor_id", "quantity", "amount", "discount", "flag", "shipped_at"]
    order = [F.struct(C(k).isNull(), C(k)).alias(k) for k in keys]
    cell = lambda kind, value: F.struct(F.when(value.isNotNull(), F.struct(kind.alias("type"), value.cast("string").alias("value"))).alias("value"))
    cells = F.array(cell(F.when(C("flag") == "kept", "string").otherwise("formula"), C("flag")), cell(F.lit("integer"), C("quantity")), cell(F.lit("number"), C("discount")))
    sheets = t("sale_lines").where("sale_id is not null").groupBy("sale_id").agg(F.array_sort(F.collect_list(F.struct(*order, cells.alias("cells")))).alias("r"))
    sheets = sheets.select(C("sale_id").alias("ordinal"), F.lit("lines").alias("name"), F.transform("r", lambda x: x["cells"]).alias("rows"), F.array(F.lit("A2:C4"), F.lit("B7")).alias("merged_ranges"))
    return scoring.row_units(sheets).select("unit_id", "non_empty", "signature", "formula", "merged")


# --- listings, boards, routing

@query("""WITH c AS (SELECT client_id, change_id, coalesce(month(valid_at), 0) AS m, coalesce(city, '?') AS city, op FROM client_changes WHERE client_id IS NOT NULL)
SELECT client_id, (2000 + m)::VARCHAR AS year, 'Change to ' || city AS title, 'f' || change_id || '.pdf' AS filename, 'file ext_' || lower(op) AS source_class, row_number() OVER (PARTITION BY client_id ORDER BY m, change_id)::INTEGER AS ordinal FROM c""")
def listing_scan(t):
    """Each client's changes as an HTML listing by year, and read again."""
    m = F.coalesce(F.month("valid_at"), F.lit(0))
    item = F.concat(F.lit('<li class="file  ext_'), F.lower("op"), F.lit("\"><a href=\"#\" onclick=\"openDocumentArticle('f"), C("change_id").cast("string"), F.lit(".pdf')\"> Change to <b>"), F.replace(F.coalesce("city", F.lit("?")), F.lit("&"), F.lit("&amp;")), F.lit("</b></a></li>\n"))
    years = t("client_changes").where("client_id is not null").groupBy("client_id", m.alias("m")).agg(F.array_sort(F.collect_list(F.struct("change_id", item.alias("item")))).alias("items"))
    part = F.concat(F.lit('<li class="dir"><a href="#">'), (C("m") + 2000).cast("string"), F.lit("</a></li>\n"), F.array_join(F.transform("items", lambda x: x["item"]), ""))
    pages = years.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("m", part.alias("part")))).alias("p"))
    html = F.concat(F.lit('<ul><li><a onclick="openDocumentArticle(\'no\')">no</a></ul><ul class="x fileTree">'), F.array_join(F.transform("p", lambda x: x["part"]), ""), F.lit("</ul>"))
    got = listing.scan_listings(pages.select("client_id", html.alias("html")), "client_id", "html")
    return got.where("problem is null").select("client_id", "year", "title", "filename", "source_class", "ordinal")


@query("""WITH c AS (SELECT client_id, change_id, op, coalesce(city, '?') AS city, row_number() OVER (PARTITION BY client_id ORDER BY change_id) AS rn FROM client_changes WHERE client_id IS NOT NULL),
g AS (SELECT client_id, string_agg('- ' || city || ' ' || change_id, chr(10) || chr(10) ORDER BY rn) FILTER (op <> 'U') AS kept, string_agg('- ' || city || ' ' || change_id || chr(10) || '  more', chr(10) ORDER BY rn) AS board, string_agg('#### ' || change_id, chr(10) || chr(10) ORDER BY rn) FILTER (op = 'U') AS blocks,
string_agg('- ' || city || ' ' || change_id || chr(10) || '  more', chr(10) || chr(10) ORDER BY rn) FILTER (op <> 'U') AS remains FROM c GROUP BY client_id)
SELECT client_id, CASE WHEN blocks IS NULL THEN 'nothing_to_do' ELSE 'graduated' END AS status, sha256('# r' || chr(10) || '## Tablero de anuncios' || chr(10) || CASE WHEN blocks IS NULL THEN board WHEN remains IS NULL THEN '- No se registraron anuncios comunitarios o logísticos en esta sesión.' || chr(10) ELSE remains || chr(10) END || chr(10) || '## Episodios' || chr(10) ||
coalesce(chr(10) || blocks || chr(10), '') || 'end') AS text_sha256 FROM g""")
def graduation(t):
    """Each client's changes on a board; the updates go from it to the episodes."""
    name = F.concat(F.coalesce("city", F.lit("?")), F.lit(" "), C("change_id").cast("string"))
    rows = t("client_changes").where("client_id is not null").groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("change_id", "op", name.alias("name")))).alias("r"))
    board = F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["name"], F.lit("\n  more"))), "\n")
    text = F.concat(F.lit("# r\n## Tablero de anuncios\n"), board, F.lit("\n## Episodios\nend"))
    moved = F.transform("r", lambda x, i: F.when(x["op"] == "U", i))
    blocks = F.transform(F.filter("r", lambda x: x["op"] == "U"), lambda x: F.concat(F.lit("#### "), x["change_id"].cast("string")))
    got = listing.graduate(rows.select("client_id", text.alias("text"), F.array_compact(moved).alias("places"), blocks.alias("blocks")), "client_id")
    return got.select("client_id", "status", F.sha2(C("text").cast("binary"), 256).alias("text_sha256"))


@query("""WITH k AS (SELECT DISTINCT kind AS thread, brand AS entity, CASE WHEN size > 25 THEN name ELSE '' END AS spoken FROM items WHERE kind IS NOT NULL AND brand IS NOT NULL), s AS (SELECT DISTINCT kind AS thread FROM items WHERE price > 400 AND kind IS NOT NULL),
c AS (SELECT vendor_id AS cluster, CASE nation_id % 2 WHEN 0 THEN 'nation ' || nation_id ELSE 'office' END AS name, name AS entity, coalesce(balance, 0)::BIGINT AS n FROM vendors WHERE nation_id IS NOT NULL),
f AS (SELECT name, min(cluster) AS cluster FROM c WHERE name NOT IN (FROM s) GROUP BY name)
SELECT name AS thread, 'cluster' AS origin, count(*) AS entities, count(*) AS signals FROM c JOIN f USING (name, cluster) GROUP BY name UNION ALL
SELECT t.thread, CASE WHEN t.thread IN (FROM s) THEN 'data' ELSE 'known' END, count(DISTINCT entity), count(entity) + count(*) FILTER (spoken <> '') FROM (SELECT thread FROM k UNION SELECT thread FROM s) t LEFT JOIN k USING (thread) WHERE t.thread NOT IN (SELECT name FROM f) GROUP BY 1, 2""")
def routing_table(t):
    items = t("items").where("kind is not null")
    known = items.where("brand is not null").select(C("kind").alias("thread"), C("brand").alias("entity"), F.when(C("size") > 25, C("name")).otherwise("").alias("full"))
    name = F.when(C("nation_id") % 2 == 0, F.concat(F.lit("nation "), C("nation_id").cast("string"))).otherwise("office")
    clusters = t("vendors").where("nation_id is not null").select(C("vendor_id").alias("cluster"), name.alias("name"), C("name").alias("entity"), F.coalesce("balance", F.lit(0)).cast("bigint").alias("n"))
    got = scoring.routing_table(items.where("price > 400").select(C("kind").alias("thread")), clusters, known)
    return got.select("thread", "origin", F.size("entities").cast("bigint").alias("entities"), F.size("signals").cast("bigint").alias("signals"))
