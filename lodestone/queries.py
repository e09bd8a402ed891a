"""Registered queries over the supplied tables, each with independent SQL.

``@query(sql)`` registers the Spark side under the function's name and the SQL under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import compat, text
from .operators import graph, quality, relational
from .sources.shared import small_batches
from .sources.tables import facets, table
from .streaming import replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def money(c, digits: int = 4):
    """An exact sum's operand."""
    return F.col(c).cast(f"decimal(18,{digits})") if isinstance(c, str) else c.cast(f"decimal(18,{digits})")


C = F.col

# --- projection, filters, aggregates


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem WHERE l_orderkey = 7")
def filter_lookup(t):
    return t("lineitem").where("l_orderkey = 7").select("l_orderkey", "l_linenumber", C("l_extendedprice").alias("price"))


@query("""WITH r AS (SELECT l_extendedprice x, row_number() OVER (ORDER BY l_extendedprice) rn, count(*) OVER () n FROM lineitem WHERE l_extendedprice IS NOT NULL)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > (SELECT x FROM r WHERE rn = n // 2 + 1)""")
def filter_upper_median(t):
    m = relational.upper_median(t("lineitem"), "l_extendedprice")
    return t("lineitem").where(C("l_extendedprice") > F.lit(m)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 5 AND l_quantity < 20")
def range_count(t):
    return t("lineitem").where("l_quantity >= 5 and l_quantity < 20").agg(F.count("*").alias("n"))


@query("SELECT sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS total FROM lineitem")
def sum_total(t):
    return t("lineitem").agg(F.sum(money("l_extendedprice")).cast("double").alias("total"))


@query("SELECT (sum(abs(value::DECIMAL(18,4))) - abs(sum(value::DECIMAL(18,4))))::DOUBLE AS cancelled FROM events")
def sum_cancellation(t):
    v = money("value")
    return t("events").agg((F.sum(F.abs(v)) - F.abs(F.sum(v))).cast("double").alias("cancelled"))


@query("SELECT count(*) AS n FROM orders")
def row_count(t):
    return t("orders").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, round(avg(o_totalprice), 4) AS mean,
coalesce(sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END), 0)::DOUBLE AS negative FROM orders GROUP BY o_orderpriority""")
def agg_allowlist(t):
    neg = compat.total(F.when(C("o_totalprice") < 0, C("o_totalprice")))
    return t("orders").groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), neg.alias("negative"))


@query("SELECT substr(p_type, 1, 3) AS prefix, count(*) AS n FROM part GROUP BY 1")
def group_prefix(t):
    return t("part").groupBy(compat.substr(C("p_type"), 1, 3).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def group_topk(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def group_full(t):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def count_distinct_keys(t):
    return t("lineitem").agg(F.countDistinct("l_partkey").alias("n"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') >= 3")
def conditional_having(t):
    return t("orders").groupBy("o_custkey").agg(F.count_if(C("o_orderstatus") == "F").alias("n_final"), F.count("*").alias("n")).where("n_final >= 3")


@query("SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey HAVING count(o.o_orderkey) < 2")
def left_group_having(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t("customer").join(n, C("c_custkey") == C("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).where("n < 2")


# --- joins

_EVENT = "SELECT event_id AS id, user_id, ts, event_type, value, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS supersedes FROM events"


def chain(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select(C("event_id").alias("id"), "user_id", "ts", "event_type", "value", F.lag("event_id").over(w).alias("supersedes"))


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000")
def join_inner(t):
    return t("orders").where("o_totalprice > 300000").join(t("customer"), C("o_custkey") == C("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT r.r_name, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
def join_chain(t):
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    j = per.join(t("customer"), C("o_custkey") == C("c_custkey")).join(t("nation"), C("c_nationkey") == C("n_nationkey")).join(t("region"), C("n_regionkey") == C("r_regionkey"))
    return j.groupBy("r_name").agg(F.sum("k").alias("n"))


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0")
def join_left(t):
    return t("customer").where("c_acctbal < 0").join(t("orders"), C("o_custkey") == C("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query(f"WITH e AS ({_EVENT}) SELECT id, user_id FROM e WHERE NOT EXISTS (SELECT 1 FROM e s WHERE s.supersedes = e.id)")
def anti_current(t):
    return relational.current(chain(t), "id", "supersedes").select("id", "user_id")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = c.c_custkey AND l.l_returnflag = 'R')")
def semi_exists(t):
    o = t("orders").join(t("lineitem").where("l_returnflag = 'R'"), C("l_orderkey") == C("o_orderkey"), "left_semi")
    return t("customer").join(o, C("o_custkey") == C("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def latest_per_key(t):
    return relational.latest_per_key(t("events"), ["user_id"], [C("ts"), C("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT a.r_regionkey AS a, b.n_nationkey AS b FROM region a CROSS JOIN nation b WHERE a.r_regionkey <> b.n_regionkey")
def cross_guarded(t):
    a, b = t("region"), t("nation")
    return a.join(b, C("r_regionkey") != C("n_regionkey")).select(C("r_regionkey").alias("a"), C("n_nationkey").alias("b"))


@query("SELECT user_id, event_type AS last_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn = 1")
def dict_last_wins(t):
    return relational.last_wins(t("events"), "user_id", "event_id").select("user_id", C("event_type").alias("last_type"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'both' END AS status FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def reconcile_full(t):
    return relational.reconcile(t("documents"), t("labels"), "doc_id")


@query("SELECT lower(substr(p_name, 1, 8)) AS key, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1")
def functional_duplicates(t):
    return relational.duplicates(t("part"), F.lower(F.substring("p_name", 1, 8)), "p_partkey")


@query("WITH e AS (SELECT n_nationkey AS a, n_regionkey + 100 AS b FROM nation) SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e")
def symmetric_neighbours(t):
    return relational.other_end(t("nation").select(C("n_nationkey").alias("a"), (C("n_regionkey") + 100).alias("b")), "a", "b")


# --- windows, order, top-k


@query("SELECT * FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS rnk FROM part) WHERE rnk <= 5")
def rank_ties(t):
    # the k-th distinct value bounds the rows that can rank at most k, so the single-partition window stays small
    least = t("part").select("p_size").orderBy(F.desc("p_size")).limit(5).agg(F.min("p_size").alias("least"))
    top = t("part").join(F.broadcast(least), C("p_size") >= C("least"))
    return top.select("p_partkey", "p_size", F.rank().over(Window.orderBy(F.desc("p_size"))).alias("rnk")).where("rnk <= 5")


@query("SELECT p_brand, n, rank() OVER (ORDER BY n DESC) AS rnk FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def rank_of_counts(t):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n")).withColumn("rnk", F.rank().over(Window.orderBy(F.desc("n"))))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr FROM events")
def row_dense(t):
    w = Window.partitionBy("user_id")
    return t("events").select("event_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("rn"), F.dense_rank().over(w.orderBy("event_type")).alias("dr"))


@query("SELECT event_id, lag(value) OVER w AS prev_value, lead(value, 2) OVER w AS next2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.lag("value").over(w).alias("prev_value"), F.lead("value", 2).over(w).alias("next2"))


@query("SELECT event_id, first_value(event_type) OVER w AS f, last_value(event_type) OVER w AS l, nth_value(event_type, 2) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def first_last_nth(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.first("event_type").over(w).alias("f"), F.last("event_type").over(w).alias("l"), F.nth_value("event_type", 2).over(w).alias("s"))


@query("SELECT event_id, (sum(value::DECIMAL(18,4)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))::DOUBLE AS moving FROM events")
def frame_sum(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return t("events").select("event_id", F.sum(money("value")).over(w).cast("double").alias("moving"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations")
def carry_forward(t):
    v = F.when(C("role") == "user", C("turn"))
    return t("conversations").select("conv_id", "turn", relational.carry_forward(t("conversations"), v, ["conv_id"], [C("turn")]).alias("last_user"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) - 1 AS number FROM conversations")
def numbering(t):
    return t("conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("role", "turn")) - 1).cast("bigint").alias("number"))


@query(f"WITH e AS ({_EVENT}) SELECT id, row_number() OVER w AS revision_no, supersedes, lead(id) OVER w IS NULL AS is_current FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)")
def revision_history(t):
    return relational.revision_history(chain(t).drop("supersedes"), "user_id", [C("ts"), C("id")]).select("id", "revision_no", "supersedes", "is_current")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 3")
def topk_ties(t):
    return t("lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_extendedprice").limit(3)


@query("SELECT source, lang, n, rank FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rank FROM documents GROUP BY source, lang) WHERE rank <= 2")
def topk_per_group(t):
    return relational.top_k(t("documents").groupBy("source", "lang").agg(F.count("*").alias("n")), ["source"], [F.desc("n"), C("lang")], 2)


@query("SELECT o_orderkey, sha256('seed' || o_orderkey::VARCHAR) AS rank_hash FROM orders ORDER BY rank_hash, o_orderkey LIMIT 20")
def hash_sample(t):
    return relational.hash_sample(t("orders"), "o_orderkey", "seed", 20).select("o_orderkey", "rank_hash")


@query("SELECT source, min(doc_id) AS first_id, max(doc_id) AS last_id, min_by(doc_id, sha256(doc_id::VARCHAR)) AS sampled FROM documents GROUP BY source")
def stratified_sample(t):
    return t("documents").groupBy("source").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.min_by("doc_id", F.sha2(C("doc_id").cast("string"), 256)).alias("sampled"))


# --- set operations, graphs


@query("SELECT count(*) AS hits FROM (SELECT c_name AS v FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part) WHERE v = 'no such value'")
def union_absence(t):
    u = t("customer").select(C("c_name").alias("v")).unionByName(t("supplier").select(C("s_name").alias("v"))).unionByName(t("part").select(C("p_name").alias("v")))
    return u.where("v = 'no such value'").agg(F.count("*").alias("hits"))


@query("""SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'either', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)""")
def set_ops(t):
    c, s, n = t("customer").select(C("c_nationkey").alias("k")), t("supplier").select(C("s_nationkey").alias("k")), t("nation").select(C("n_nationkey").alias("k"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k")
    return named(c.intersect(s), "both").unionByName(named(c.union(s).distinct(), "either")).unionByName(named(n.subtract(s), "only"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_diff(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 97 AS src, l_partkey % 97 AS dst FROM lineitem WHERE l_orderkey % 50 = 0),
r(node, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT DISTINCT node, depth FROM r""")
def reach_bounded(t):
    e = t("lineitem").where("l_orderkey % 50 = 0").select((C("l_suppkey") % 97).alias("src"), (C("l_partkey") % 97).alias("dst")).distinct()
    return graph.reach(e, e.sparkSession.createDataFrame([(5,)], "node bigint"), 3).select("node", "depth")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 97 AS src, l_partkey % 97 AS dst FROM lineitem),
r(node, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT DISTINCT node, depth FROM r""")
def reach_bounded_all(t):
    """reach_bounded over the edges of all orders."""
    e = t("lineitem").select((C("l_suppkey") % 97).alias("src"), (C("l_partkey") % 97).alias("dst")).distinct()
    return graph.reach(e, e.sparkSession.createDataFrame([(5,)], "node bigint"), 3).select("node", "depth")


@query("SELECT n_nationkey AS node, n_regionkey AS ancestor, 1 AS depth FROM nation UNION ALL SELECT n_nationkey, 1000, 2 FROM nation")
def ancestors(t):
    up = t("nation").select(C("n_nationkey").alias("src"), (C("n_regionkey") + 500).alias("dst")).unionByName(t("region").select((C("r_regionkey") + 500).alias("src"), F.lit(1500).alias("dst")))
    got = graph.reach(up, t("nation").select(C("n_nationkey").alias("node")), 2).where("depth > 0")
    return got.select(C("start").alias("node"), (C("node") - 500).alias("ancestor"), "depth")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey = 3 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3 GROUP BY l_partkey HAVING count(*) > 1)")
def parallel_edges(t):
    e = t("lineitem").where("l_suppkey = 3")
    return e.join(e.groupBy("l_partkey").agg(F.count("*").alias("n")).where("n > 1"), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_suppkey, l_partkey) IN (SELECT (l_suppkey, l_partkey) FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1)")
def parallel_edges_all(t):
    """parallel_edges over all suppliers."""
    e, pair = t("lineitem"), ["l_suppkey", "l_partkey"]
    return e.join(e.groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1"), pair, "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_PAIRS = """WITH i AS (SELECT DISTINCT o.o_custkey AS item, l.l_partkey AS f FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey), n AS (SELECT item, count(*) AS n FROM i GROUP BY item),
p AS (SELECT a.item AS a, b.item AS b, count(*) AS shared FROM i a JOIN i b ON a.f = b.f AND a.item < b.item GROUP BY 1, 2),
j AS (SELECT a, b, shared, shared / (na.n + nb.n - shared)::DOUBLE AS jaccard FROM p JOIN n na ON na.item = a JOIN n nb ON nb.item = b WHERE shared >= 3 OR shared / (na.n + nb.n - shared)::DOUBLE >= 0.05)"""


def _baskets(t):
    items = t("orders").join(t("lineitem"), C("o_orderkey") == C("l_orderkey")).select(C("o_custkey").alias("item"), C("l_partkey").alias("f")).distinct()
    return relational.shared_pairs(items, "item", "f", 3, 0.05)


@query(_PAIRS + " SELECT a, b, shared, jaccard FROM j")
def pair_overlap_jaccard(t):
    return _baskets(t)


@query(_PAIRS.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT a AS src, b AS dst FROM j UNION SELECT b, a FROM j), r(node, m) AS (SELECT src, src FROM e UNION SELECT e.dst, r.m FROM r JOIN e ON e.src = r.node WHERE r.m < e.dst)
SELECT node, min(m) AS component FROM r GROUP BY node""")
def cluster_components(t):
    return graph.components(_baskets(t).select(C("a").alias("src"), C("b").alias("dst")))


# --- scalar and text functions


@query("""SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, length(p_name) AS n, replace(p_type, ' ', '_') AS r, round(p_retailprice / 7, 2) AS q, abs(p_size - 25) AS d,
CASE WHEN p_size = 1 THEN NULL ELSE p_size END AS nn, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice / (p_size % 5) END AS safe FROM part""")
def scalar_allowlist(t):
    return t("part").select(
        "p_partkey", F.lower("p_name").alias("lo"), F.upper("p_brand").alias("up"), F.length("p_name").cast("bigint").alias("n"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("r"),
        F.round(C("p_retailprice") / 7, 2).alias("q"), F.abs(C("p_size") - 25).alias("d"), F.nullif("p_size", F.lit(1)).alias("nn"), compat.divide(C("p_retailprice"), C("p_size") % 5).alias("safe"),
    )


@query(r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS clean FROM documents")
def normalize_text(t):
    return small_batches(t("documents")).select("doc_id", text.normalize_text(C("text")).alias("clean"))


@query("SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug FROM part")
def slug_titles(t):
    return t("part").select("p_partkey", text.slug(C("p_name")).alias("slug"))


@query(r"SELECT doc_id, m AS found FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|AKIA[0-9A-Z]{16}')) AS m FROM documents)")
def entity_extract_codes(t):
    return t("documents").select("doc_id", F.explode(text.find_all(C("text"), r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|AKIA[0-9A-Z]{16}")).alias("found"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'legal' END, CASE WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') THEN 'secrets' END) AS topics FROM documents""")
def detect_topics(t):
    got = text.topics(C("text"), {"legal": ["license", "copyright"], "secrets": ["password", "token"]})
    return t("documents").select("doc_id", F.array_join(got, ",").alias("topics"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_parse(t):
    months = F.array(*[F.lit(m) for m in text.MONTHS])
    d = C("o_orderdate")
    spanish = F.concat_ws(" de ", F.dayofmonth(d).cast("string"), F.element_at(months, F.month(d)), F.year(d).cast("string"))
    return t("orders").select("o_orderkey", text.spanish_date(spanish).alias("iso"))


@query("SELECT page_id, (SELECT min(y) FROM range(2000, 2031) r(y) WHERE contains(html, y::VARCHAR))::INTEGER AS year FROM pages")
def year_detect(t):
    return t("pages").select("page_id", text.year_of(C("html")).alias("year"))


@query(r"SELECT page_id, m AS item FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"/([^\"<>]*)\">', 1)) AS m FROM pages)")
def html_listing(t):
    return t("pages").select("page_id", F.explode(text.find_all(C("html"), r'<li><a href="/([^"<>]*)">', 1)).alias("item"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT item_id, levenshtein(left(text, 60), left(lower(text), 60)) / greatest(length(left(text, 60)), 1)::DOUBLE AS cer FROM benchmark")
def char_error_rate(t):
    a = F.substring("text", 1, 60)
    return t("benchmark").select("item_id", text.char_error_rate(a, F.lower(a)).alias("cer"))


@query("SELECT item_id, levenshtein(text, lower(text)) / greatest(length(text), 1)::DOUBLE AS cer FROM benchmark")
def char_error_rate_whole(t):
    """char_error_rate over the whole texts."""
    return t("benchmark").select("item_id", text.char_error_rate(C("text"), F.lower("text")).alias("cer"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2)
SELECT doc_id, sum(n)::BIGINT AS tokens, count(*) AS kinds, max(n) AS most FROM c GROUP BY doc_id""".replace("\\\\", "\\"))
def token_multiset(t):
    return text.multiset_sizes(t("documents"), "doc_id", C("text"))


@query("SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'license')")
def fts_match(t):
    return t("documents").where(F.array_contains(F.split(F.lower("text"), "[^a-z0-9]+"), "license")).select("doc_id")


@query("SELECT doc_id, u AS unit, length(line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS u FROM documents) WHERE line <> ''")
def partition_units(t):
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("u", "line")).where("line <> ''").select("doc_id", (C("u") + 1).cast("bigint").alias("unit"), F.length("line").cast("bigint").alias("n"))


@query("SELECT l_orderkey, l_linenumber, 'number' AS c1_kind, l_quantity::VARCHAR AS c1_text, NULL::BIGINT AS c1_integer, l_quantity AS c1_number FROM lineitem")
def cell_facets(t):
    f = facets(F.lit("number"), C("l_quantity"), "c1")
    return t("lineitem").select("l_orderkey", "l_linenumber", *f[:4])


# --- reports, decisions, checks


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def multi_label_distribution(t):
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM events GROUP BY event_type")
def share_pct(t):
    n = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(C("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).cast("double"))


@query("SELECT event_type, string_agg(DISTINCT strftime(ts, '%d'), ',' ORDER BY strftime(ts, '%d')) AS days FROM events GROUP BY event_type")
def set_per_group(t):
    return t("events").groupBy("event_type").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.date_format("ts", "dd")))).alias("days"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def pivot_status(t):
    c = [F.count_if(C("o_orderstatus") == s).alias(s.lower()) for s in "FOP"]
    return t("orders").groupBy("o_orderpriority").agg(*c)


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) rn FROM lineitem) WHERE rn = 1")
def argmax_first(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", -C("l_linenumber"))).alias("l_linenumber"))


@query("SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def custody_dedup(t):
    return relational.duplicates(t("documents"), F.sha2("text", 256), "doc_id")


@query("""SELECT source, count(*) FILTER (WHERE quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (WHERE quality <> 1 AND n_chars >= 500) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars < 500) AS fn, count(*) AS n,
CASE WHEN count(*) FILTER (WHERE n_chars >= 500) > 0 THEN count(*) FILTER (WHERE quality = 1 AND n_chars >= 500) / count(*) FILTER (WHERE n_chars >= 500)::DOUBLE END AS precision,
CASE WHEN count(*) FILTER (WHERE quality = 1) > 0 THEN count(*) FILTER (WHERE quality = 1 AND n_chars >= 500) / count(*) FILTER (WHERE quality = 1)::DOUBLE END AS recall
FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def recall_precision(t):
    j = t("documents").select("doc_id", "source", "n_chars").join(t("labels"), "doc_id")
    return quality.precision_recall(j, C("quality") == 1, C("n_chars") >= 500, ["source"])


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN 'quarantine_review' WHEN (length(text) - length(replace(text, '#', ''))) / greatest(n_chars, 1)::DOUBLE > 0.02 THEN 'escalate' WHEN least(n_chars / 200.0, 1) < 0.5 THEN 'escalate' ELSE 'accept' END AS decision,
CASE WHEN n_chars = 0 THEN 'no_text' WHEN (length(text) - length(replace(text, '#', ''))) / greatest(n_chars, 1)::DOUBLE > 0.02 THEN 'replacement_characters' WHEN least(n_chars / 200.0, 1) < 0.5 THEN 'low_coverage' ELSE 'within_limits' END AS reason FROM documents""")
def quality_decision(t):
    share = (F.length("text") - F.length(F.replace("text", F.lit("#"), F.lit("")))) / F.greatest("n_chars", F.lit(1))
    d = quality.decision(C("n_chars") == 0, share, F.least(C("n_chars") / 200, F.lit(1.0)))
    return t("documents").select("doc_id", d.alias("d")).select("doc_id", "d.*")


@query("""SELECT 'orphan_label' AS rule, doc_id::VARCHAR AS key FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'bad_quality', doc_id::VARCHAR FROM labels WHERE quality NOT IN (0, 1)
UNION ALL SELECT 'orphan_order', o_custkey::VARCHAR FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'duplicate_line', l_orderkey || ':' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def violations_union(t):
    dup = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key"))
    return quality.violations({
        "orphan_label": quality.orphans(t("labels"), "doc_id", t("documents"), "doc_id"), "bad_quality": t("labels").where(~C("quality").isin(0, 1)).select(C("doc_id").alias("key")),
        "orphan_order": quality.orphans(t("orders"), "o_custkey", t("customer"), "c_custkey"), "duplicate_line": dup,
    })


@query("""SELECT o_orderkey AS row, 1 AS col, 'number' AS ka, o_totalprice::VARCHAR AS va, 'number' AS kb, (o_totalprice + 1)::VARCHAR AS vb FROM orders WHERE o_orderkey % 100 = 0""")
def result_diff(t):
    o = t("orders").select(C("o_orderkey").alias("row"), F.lit(1).alias("col"), F.lit("number").alias("kind"), C("o_totalprice").alias("x"))
    left = o.select("row", "col", "kind", C("x").cast("string").alias("value"))
    right = o.select("row", "col", "kind", F.when(C("row") % 100 == 0, C("x") + 1).otherwise(C("x")).cast("string").alias("value"))
    return quality.compare_cells(left, right)


@query("SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1 OR p IS DISTINCT FROM event_type")
def change_points(t):
    return replay.change_points(t("events"), "user_id", C("event_type"), [C("ts"), C("event_id")]).select("event_id", "user_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events WHERE event_type <> 'error') WHERE rn = 1")
def latest_success(t):
    return replay.latest_success(t("events"), "user_id", C("event_type") != "error", [C("ts"), C("event_id")]).select("user_id", "event_id")


@query("""SELECT n_name, revenue, rnk FROM (SELECT n_name, revenue, rank() OVER (ORDER BY revenue DESC) AS rnk FROM (SELECT n.n_name, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name)) WHERE rnk <= 10""")
def flagship(t):
    per = t("lineitem").join(t("orders"), C("l_orderkey") == C("o_orderkey")).groupBy("o_custkey").agg(F.sum((C("l_extendedprice") * (1 - C("l_discount"))).cast("decimal(18,4)")).alias("r"))
    named = per.join(t("customer"), C("o_custkey") == C("c_custkey")).join(t("nation"), C("c_nationkey") == C("n_nationkey")).groupBy("n_name").agg(F.sum("r").cast("double").alias("revenue"))
    return named.withColumn("rnk", F.rank().over(Window.orderBy(F.desc("revenue")))).where("rnk <= 10")


from . import action_queries, archive_queries, corpus_queries, record_queries, score_queries  # noqa: E402,F401  they register their queries in the tables above
