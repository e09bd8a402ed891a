"""Registered queries over connectors, the kept index, review units, obligations, promotion, commits and purges."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import units
from .operators import obligations, promotion, purge, retrieval
from .queries import ORACLE_SQL, QUERIES, C, query
from .sources import connector, versions
from .sources.shared import shared_folder
from .sources.tables import table
from .streaming import inbox


def job(sql: str | None):
    """A query that writes tables of its own on the way, in new folders of the shared one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- connectors and the inbox


def _feed(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.readStream.format(connector.register(spark)).options(path=path, **options).load()


@job("""SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS locator, ts AS observed_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS outcome, value,
(SELECT count(*) FROM events) AS replayed FROM events""")
def connector_replay(spark, sf_dir):
    """All events through the connector in steps, then once more from the start: nothing is lost or repeated."""
    folder = shared_folder(spark, "inbox")
    options = {"id": "event_id", "locator": "user_id", "observed_at": "ts", "outcome": "event_type", "failed": "error", "rows_per_step": "20000", "catch_up": "0.25"}
    feed = lambda: _feed(spark, f"{sf_dir}/events.parquet", **options)
    inbox.run_connector(spark, connector.RecordFeed.descriptor, feed(), f"{folder}/rows", f"{folder}/state")
    again = inbox.run_connector(spark, connector.RecordFeed.descriptor, feed(), f"{folder}/rows", f"{folder}/state", restart=True)
    rows = inbox.received(spark, f"{folder}/rows")
    value = F.get_json_object("payload", "$.value").cast("double")
    return rows.select("id", "locator", "observed_at", "outcome", value.alias("value"), F.lit(again.replayed).cast("bigint").alias("replayed"))


@job("""SELECT client_id::VARCHAR AS locator, ts AS observed_at, click_id::VARCHAR AS id FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts DESC NULLS LAST, click_id DESC) AS rn FROM clicks WHERE kind IS DISTINCT FROM 'error') WHERE rn = 1""")
def stream_state(spark, sf_dir):
    """Latest success of each client, kept by a stream's state; only what a step changed is written."""
    folder = shared_folder(spark, "latest")
    feed = _feed(spark, f"{sf_dir}/clicks.parquet", id="click_id", locator="client_id", observed_at="ts", outcome="kind", failed="error", rows_per_step="20000", catch_up="0.25")
    inbox.run_latest(feed, f"{folder}/rows", f"{folder}/state")
    return inbox.latest(spark, f"{folder}/rows").select("locator", "observed_at", "id")


# --- the kept index

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _index(spark: SparkSession, sf_dir: str) -> retrieval.TextIndex:
    """An index that saw two thirds of the documents, every fifth of them cut short, before it saw them all."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True)), "doc_id", "left")
    docs = docs.withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    index = retrieval.TextIndex(spark, f"postings_{uuid.uuid4().hex}", shared_folder(spark, "index"), ("lang", "source", "toxic"))
    early = docs.where("doc_id % 3 <> 0").withColumn("text", F.when(C("doc_id") % 5 == 0, F.substring("text", 1, 40)).otherwise(C("text")))
    index.update(early, "doc_id", "text")
    index.update(docs, "doc_id", "text")
    return index


@job(rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id AS doc, len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the' AND w[i + 1] = 'apache' AND w[i + 2] = 'license'))::INTEGER AS places FROM d WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' the apache license ')""")
def index_phrase(spark, sf_dir):
    found = _index(spark, sf_dir).phrase(["the", "Apache", "license"])
    return found.select("doc", F.size("starts").alias("places"))


@job(rf"""SELECT DISTINCT doc_id AS doc, token FROM (SELECT doc_id, unnest({_WORDS}) AS token FROM documents) WHERE starts_with(token, 'licen')""")
def index_prefix(spark, sf_dir):
    return _index(spark, sf_dir).prefix("Licen")


@job(rf"""SELECT doc_id AS doc, lang, source FROM documents WHERE lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND list_contains({_WORDS}, 'under') AND list_contains({_WORDS}, 'license')
AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE n_chars > 500)""")
def index_retrieve(spark, sf_dir):
    """Documents that hold two words, filtered by kept columns and by a relation."""
    index = _index(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1").select(C("doc_id").alias("doc")).union(table(spark, sf_dir, "documents").where("n_chars > 500").select("doc_id"))
    return index.retrieve(index.holding(["under", "license"]), C("lang").isin("en", "de"), ~C("toxic"), related=good).select("doc", "lang", "source")


# --- review units and obligations


@query(None)
def review_units(t):
    return units.review_units(t("documents"), "doc_id", "text")


@query("SELECT doc_id, sha256(text) AS whole, length(text) AS chars, 0::BIGINT AS gaps FROM documents WHERE length(text) > 0")
def review_units_whole(t):
    """The units of each text, put together again."""
    u = units.review_units(t("documents"), "doc_id", "text")
    before = F.lag("char_end", 1, 0).over(Window.partitionBy("doc_id").orderBy("char_start"))
    joined = u.withColumn("gap", before != C("char_start")).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "text"))), lambda x: x["text"]), "").alias("text"), F.max("char_end").cast("bigint").alias("chars"), F.count_if("gap").alias("gaps")
    )
    return joined.select("doc_id", F.sha2(C("text").cast("binary"), 256).alias("whole"), "chars", "gaps")


#: Hall's condition over the three patterns of a sale, by counting the lines that fit each set of them.
_HALL = """WITH s AS (SELECT sale_id, max(quantity) AS q, min(flag) AS lo, max(flag) AS hi FROM sale_lines GROUP BY sale_id),
f AS (SELECT s.sale_id, (q IS NOT DISTINCT FROM item_id OR q IS NOT DISTINCT FROM vendor_id OR q IS NOT DISTINCT FROM quantity) AS a, a AND flag IS NOT DISTINCT FROM lo AS b, flag IS NOT DISTINCT FROM hi AS c FROM sale_lines l JOIN s ON s.sale_id IS NOT DISTINCT FROM l.sale_id),
n AS (SELECT sale_id, count(*) AS lines, greatest(0, 1 - count(*) FILTER (a), 1 - count(*) FILTER (b), 1 - count(*) FILTER (c), 2 - count(*) FILTER (a OR b), 2 - count(*) FILTER (a OR c), 2 - count(*) FILTER (b OR c), 3 - count(*) FILTER (a OR b OR c)) AS short FROM f GROUP BY sale_id)
SELECT sale_id, lines, (3 - short)::BIGINT AS matched, short = 0 AS met FROM n"""


@query(_HALL)
def obligation_match(t):
    """Each sale owes three lines of its own: one with its greatest quantity, one with that and its first flag, one
    with its last flag."""
    lines = t("sale_lines")
    number, word = lambda c: obligations.typed_key(F.lit("integer"), C(c).cast("string")), lambda c: obligations.typed_key(F.lit("text"), C(c))
    case = F.coalesce(C("sale_id"), F.lit(-1)).alias("case")
    rows = lines.select(case, F.monotonically_increasing_id().alias("row"), F.array(number("item_id"), number("vendor_id"), number("quantity"), word("flag")).alias("values"))
    owed = lines.groupBy(case).agg(F.max("quantity").alias("q"), F.min("flag").alias("lo"), F.max("flag").alias("hi"))
    sets = F.array(F.array(number("q")), F.array(number("q"), word("lo")), F.array(word("hi")))
    got = obligations.row_sets(rows, owed.select("case", F.posexplode(sets).alias("pattern", "values")))
    return got.select(F.when(C("case") >= 0, C("case")).alias("sale_id"), C("rows").alias("lines"), "matched", "met")


# --- promotion, commits, purges

_CHAIN = "PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey"


@query(f"""WITH o AS (SELECT *, o_totalprice > 400000 AS seed FROM orders), c AS (SELECT *, bool_or(seed) OVER ({_CHAIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tainted FROM o),
bad AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < -500), e AS (SELECT l.*, l_returnflag <> 'R' AND l_linestatus = 'O' AS counts FROM lineitem l),
v AS (SELECT e.l_orderkey, e.l_linenumber, e.l_partkey, bool_or(coalesce(g.l_linenumber IS NOT NULL, false)) AS inside FROM e LEFT JOIN lineitem g ON g.l_orderkey = e.l_orderkey AND g.l_suppkey = e.l_suppkey AND g.l_linenumber <= 4 AND e.l_partkey BETWEEN g.l_partkey - 50 AND g.l_partkey + 50 WHERE e.counts GROUP BY ALL),
n AS (SELECT l_orderkey, bool_and(inside) AS covered FROM v GROUP BY l_orderkey), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey IN (FROM bad)), h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber <= 4)
SELECT o_orderkey AS claim, CASE WHEN o_orderstatus = 'P' THEN 'origin_unavailable' WHEN o_orderkey NOT IN (FROM h) THEN 'lineage_missing' WHEN tainted AND o_orderpriority <> '5-LOW' THEN 'restricted_input' WHEN NOT covered THEN 'evidence_not_covered'
WHEN b.l_orderkey IS NOT NULL AND o_orderpriority <> '5-LOW' THEN 'restricted_evidence' END AS problem FROM c LEFT JOIN n ON n.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey""")
def promotion_covered(t):
    """Orders as claims derived from the customer's earlier orders of the year, order lines as evidence."""
    o, lines = t("orders"), t("lineitem")
    claims = o.select(C("o_orderkey").alias("claim"), C("o_orderkey").alias("derivation"), (C("o_orderstatus") != "P").alias("available"), F.lit("exact").alias("lineage_state"), F.when(C("o_orderpriority") == "5-LOW", "restricted").otherwise("active").alias("lifecycle"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderkey"))
    uses = o.select(before.alias("src"), C("o_orderkey").alias("dst")).where("src is not null")
    # sources have keys of their own, below those of derivations
    source = (-1 - C("l_suppkey")).alias("source")
    restricted = o.where("o_totalprice > 400000").select(C("o_orderkey").alias("node")).union(t("supplier").where("s_acctbal < -500").select(-1 - C("s_suppkey")))
    evidence = lines.select(C("l_orderkey").alias("claim"), C("l_orderkey").alias("derivation"), F.struct("l_linenumber", "l_partkey").alias("evidence"), source, C("l_partkey").alias("part"),
                            F.when(C("l_returnflag") == "R", "contradicts").otherwise("supports").alias("relation"), F.when(C("l_linestatus") == "O", "active").otherwise("retired").alias("lifecycle"))
    lineage = lines.where("l_linenumber <= 4").select(C("l_orderkey").alias("derivation"), source, C("l_partkey").alias("target"))
    return promotion.promotions(claims, evidence, lineage, C("part").between(C("target") - 50, C("target") + 50), uses, restricted)


@job("""SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o_orderkey) AS links, (SELECT count(DISTINCT l_partkey) FROM lineitem l WHERE l.l_orderkey = o_orderkey) AS mentions, 2::BIGINT AS version FROM orders""")
def commit_families(spark, sf_dir):
    """Orders with their lines and parts in two commits of three tables each; the first is sent twice."""
    store = versions.VersionedStore(spark, shared_folder(spark, "store"))
    checks = {"links have claims": versions.orphans("links", "claim", "claims", "o_orderkey"), "mentions have claims": versions.orphans("mentions", "claim", "claims", "o_orderkey"), "claims are unique": versions.repeated("claims", "o_orderkey")}
    parts = [C("o_orderstatus") == "F", C("o_orderstatus") != "F"]
    for k, part in enumerate((*parts, parts[0])):
        claims = table(spark, sf_dir, "orders").where(part).select("o_orderkey", "o_orderstatus")
        lines = table(spark, sf_dir, "lineitem").join(claims, C("l_orderkey") == C("o_orderkey")).select(C("l_orderkey").alias("claim"), "l_linenumber", "l_partkey")
        receipt = store.commit(f"orders-{k % 2}", f"digest-{k % 2}", {"claims": claims, "links": lines, "mentions": lines.select("claim", "l_partkey").distinct()}, checks)
    if not receipt.replayed:
        raise AssertionError("a commit that was sent again was taken for a new one")
    links, mentions = (store.read(x).groupBy("claim").agg(F.count("*").alias(x)) for x in ("links", "mentions"))
    out = store.read("claims").join(links.withColumnRenamed("claim", "c1"), C("o_orderkey") == C("c1"), "left").join(mentions.withColumnRenamed("claim", "c2"), C("o_orderkey") == C("c2"), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("o_orderkey", "o_orderstatus", count("links"), count("mentions"), F.lit(store.manifest()["version"]).cast("bigint").alias("version"))


@query("""WITH own AS (SELECT 'document' AS kind, doc_id::VARCHAR AS owner, sha256(text) AS object FROM documents UNION SELECT 'turn', conv_id || '-' || turn, sha256(text) FROM conversations UNION SELECT 'item', item_id::VARCHAR, sha256(text) FROM benchmark),
m AS (SELECT own.*, kind = 'document' AND owner IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 0) AS asked FROM own WHERE object IS NOT NULL AND owner IS NOT NULL)
SELECT object, count(*) FILTER (asked) AS purged, count(*) FILTER (NOT asked) AS living, CASE WHEN count(*) FILTER (NOT asked) = 0 THEN 'delete_bytes' ELSE 'keep_shared' END AS action FROM m GROUP BY object HAVING count(*) FILTER (asked) > 0""")
def purge_owned(t):
    """Documents of low quality are purged; the bytes of a text go with its last document, turn or item."""
    digest = F.sha2(C("text").cast("binary"), 256).alias("object")
    turn = F.concat(C("conv_id").cast("string"), F.lit("-"), C("turn").cast("string")).alias("owner")
    owned = purge.owners(document=t("documents").select(C("doc_id").alias("owner"), digest), turn=t("conversations").select(turn, digest), item=t("benchmark").select(C("item_id").alias("owner"), digest))
    asked = t("labels").where("quality = 0").select(F.lit("document").alias("kind"), C("doc_id").cast("string").alias("owner"))
    return purge.object_fates(owned, asked)
