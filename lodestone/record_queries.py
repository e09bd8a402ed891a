"""Registered queries over selectors, review and claim control, quality, audits, routing and record scores.

The supplied tables stand in for the records; what a row stands for is derived in the query and, independently,
in its SQL, from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text
from .operators import quality, relational, review, selectors
from .queries import C, query
from .sources import tables

# --- selectors


@query("""SELECT doc_id, CASE WHEN substr(text, 11, 20) <> q THEN 'offsets' END AS at_offsets,
CASE WHEN instr(text, p) = 0 OR instr(substr(text, instr(text, p) + 1), p) > 0 THEN 'not_unique' END AS anywhere
FROM (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN reverse(substr(text, 11, 20)) ELSE substr(text, 11, 20) END AS q, substr(text, 6, 15) AS p FROM documents WHERE length(text) >= 40)""")
def quote_reopen(t):
    d = t("documents").where(F.length("text") >= 40)
    exact = F.substring("text", 11, 20)
    moved = F.when(C("doc_id") % 7 == 0, F.reverse(exact)).otherwise(exact)
    offsets = selectors.quote_problem(C("text"), moved, F.lit(10), F.lit(30), F.substring("text", 6, 5))
    return d.select("doc_id", offsets.alias("at_offsets"), selectors.quote_problem(C("text"), F.substring("text", 11, 10), prefix=F.substring("text", 6, 5)).alias("anywhere"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT l_orderkey, string_agg(l_partkey || ',' || l_suppkey, ';' ORDER BY rn) FILTER (WHERE rn BETWEEN 2 AND 3) AS cells, count(*) FILTER (WHERE rn BETWEEN 2 AND 3) = 2 AS reopened FROM r GROUP BY l_orderkey HAVING count(*) >= 2""")
def table_range_reopen(t):
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r")).where(F.size("r") >= 2)
    cells = F.transform("r", lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string")))
    got = selectors.table_slice(cells, F.lit("B2:C3"))
    return rows.select("l_orderkey", F.array_join(F.transform(got, lambda x: F.array_join(x, ",")), ";").alias("cells"), (F.size(got) == 2).alias("reopened"))


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN n_chars % 3 = 0 THEN 'bad_value' END WHEN 2 THEN 'unknown_key' WHEN 3 THEN 'missing_key' WHEN 4 THEN CASE WHEN n_chars % 5 < 3 THEN 'bad_value' END
WHEN 5 THEN 'unknown_kind' WHEN 6 THEN 'not_an_object' ELSE CASE WHEN n_chars % 2 = 0 THEN 'bad_value' END END AS problem FROM documents WHERE n_chars IS NOT NULL""")
def selector_valid(t):
    k, n = C("doc_id") % 8, C("n_chars")
    kind = F.element_at(F.array(*map(F.lit, ("whole", "pdf_page", "pdf_page", "pdf_page_quote", "text_quote", "audio", "whole", "table_range"))), (k + 1).cast("int"))
    payload = (
        F.when(k == 0, "{}").when(k == 1, F.concat(F.lit('{"page_ordinal":'), (n % 3).cast("string"), F.lit("}"))).when(k == 2, '{"page_ordinal":3,"zoom":2}').when(k == 3, '{"page_ordinal":3}')
        .when(k == 4, F.concat(F.lit('{"exact":"x","start_char":2,"end_char":'), (n % 5).cast("string"), F.lit("}"))).when(k == 5, "{}").when(k == 6, "[1]")
        .otherwise(F.concat(F.lit('{"sheet":"s","a1_range":"B2:'), F.when(n % 2 == 0, "A9").otherwise("AB9"), F.lit('"}')))
    )
    return t("documents").where("n_chars is not null").select("doc_id", selectors.selector_problem(kind, payload).alias("problem"))


@query("""SELECT a.l_orderkey AS k, a.l_partkey AS a, b.l_partkey AS b, a.l_partkey <= b.l_partkey AND a.l_partkey + a.l_quantity * 20 >= b.l_partkey + b.l_quantity AS chars,
a.l_suppkey <= b.l_suppkey AND a.l_linenumber <= b.l_linenumber AND a.l_suppkey + 30 >= b.l_suppkey + 5 AND a.l_linenumber + 9 >= b.l_linenumber + 2 AS cells
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def scope_contains(t):
    letters, q, r = selectors.column_letters, F.lit("text_quote"), F.lit("table_range")

    def side(name, wide, cols, rows):
        end = (C("l_partkey") + C("l_quantity") * wide).cast("bigint")
        span = F.to_json(F.struct(F.lit("x").alias("exact"), C("l_partkey").alias("start_char"), end.alias("end_char")))
        # a key that grows with the table is a row, since columns end at ZZZ
        rect = F.concat(letters(C("l_linenumber") + 1), C("l_suppkey") + 1, F.lit(":"), letters(C("l_linenumber") + 1 + cols), C("l_suppkey") + 1 + rows)
        area = F.to_json(F.struct(F.lit("s").alias("sheet"), rect.alias("a1_range")))
        made = t("lineitem").select(C("l_orderkey").alias(f"k{name}"), C("l_linenumber").alias(f"n{name}"), C("l_partkey").alias(name), span.alias("span"), area.alias("area"))
        # a line meets all others of its order: its selectors are read before that
        return made.select(f"k{name}", f"n{name}", name, selectors.scope(q, C("span")).alias(f"span{name}"), selectors.scope(r, C("area")).alias(f"area{name}"))

    both = side("a", 20, 9, 30).join(side("b", 1, 2, 5), (C("ka") == C("kb")) & (C("na") < C("nb")))
    return both.select(C("ka").alias("k"), "a", "b", selectors.within(q, C("spana"), q, C("spanb")).alias("chars"), selectors.within(r, C("areaa"), r, C("areab")).alias("cells"))


@query("""SELECT doc_id, CASE WHEN n_chars % 4 = 0 OR n_chars < 10 THEN 'span' WHEN doc_id % 5 = 0 THEN 'bytes' END AS problem FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL""")
def media_reopen(t):
    d = t("documents").where("text is not null and n_chars is not null")
    digest = F.when(C("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")).cast("binary"), 256)).otherwise(F.sha2(C("text").cast("binary"), 256))
    end = F.when(C("n_chars") % 4 == 0, C("n_chars") + 1).otherwise(C("n_chars"))
    return d.select("doc_id", selectors.media_problem(C("text").cast("binary"), digest, C("n_chars"), F.lit(9), end).alias("problem"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (l_returnflag <> 'N')::INT + (l_discount > 0)::INT + 1 AS filled, CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_discount > 0 THEN 'integer,number,text' ELSE 'integer,text' END
WHEN l_discount > 0 THEN 'integer,number' ELSE 'integer' END AS signature, l_linenumber BETWEEN 2 AND 3 OR l_linenumber = 6 AS merged FROM lineitem""")
def row_features(t):
    blank = F.lit(None).cast("string")
    cells = F.array(
        F.struct(F.lit("text").alias("kind"), F.when(C("l_returnflag") != "N", C("l_returnflag")).otherwise(blank).alias("value")),
        F.struct(F.lit("number").alias("kind"), F.when(C("l_discount") > 0, C("l_discount").cast("string")).otherwise(blank).alias("value")),
        F.struct(F.lit("integer").alias("kind"), C("l_partkey").cast("string").alias("value")),
    )
    filled = F.filter(cells, lambda x: x["value"].isNotNull())
    signature = F.array_join(F.array_sort(F.array_distinct(F.transform(filled, lambda x: x["kind"]))), ",")
    merged = selectors.row_in_ranges(C("l_linenumber"), F.array(F.lit("A2:C3"), F.lit("B6")))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.size(filled).alias("filled"), signature.alias("signature"), merged.alias("merged"))


@query("""SELECT doc_id, regexp_matches(sha256(coalesce(text, '')), '^[0-9a-f]{64}$') AS digest, doc_id % 2 = 0 AS prefixed, regexp_matches(coalesce(source, ''), '^[a-z][a-z0-9_.-]*$') AS token FROM documents""")
def domain_checks(t):
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    ident = F.concat(F.when(C("doc_id") % 2 == 0, "rtgt_").otherwise("clm_"), C("doc_id").cast("string"))
    return t("documents").select("doc_id", text.is_sha256(sha).alias("digest"), ident.startswith("rtgt_").alias("prefixed"), text.is_token(F.coalesce("source", F.lit(""))).alias("token"))


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1998-01-01'")
def since_filter(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t("orders").where(text.is_iso_date(iso) & (iso >= "1998-01-01")).select("o_orderkey")


# --- quality and verification

_SIGNAL_SQL = """SELECT doc_id, 'native.page_text_coverage' AS key, CASE WHEN n_chars / 1000.0 > 1 THEN 'bad_payload' END AS problem FROM d UNION ALL SELECT doc_id, 'native.page_character_count', CASE WHEN n_chars % 2 = 1 THEN 'bad_payload' END FROM d
UNION ALL SELECT doc_id, 'core.output_nonempty', CASE WHEN doc_id % 3 = 0 THEN 'bad_payload' END FROM d UNION ALL SELECT doc_id, 'native.empty_page_ordinals', CASE WHEN doc_id % 5 < 3 THEN 'bad_payload' END FROM d
UNION ALL SELECT doc_id, 'ocr.word_confidence_summary', CASE WHEN n_chars > 100 THEN 'bad_payload' END FROM d UNION ALL SELECT doc_id, 'multimodal.uncertain_spans', CASE WHEN n_chars > 512 THEN 'bad_payload' END FROM d UNION ALL SELECT doc_id, 'other.signal', 'unknown_signal' FROM d"""


@query("WITH d AS (SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL) " + _SIGNAL_SQL)
def signal_registry(t):
    n, k = C("n_chars"), C("doc_id")
    join = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    payload = {
        "native.page_text_coverage": join(n / F.lit(1000.0).cast("decimal(6,1)")), "native.page_character_count": F.when(n % 2 == 1, join(-n - 1)).otherwise(join(n)),
        "core.output_nonempty": F.when(k % 3 == 0, "1").otherwise("true"), "native.empty_page_ordinals": F.when(k % 5 == 0, "[2,1]").when(k % 5 == 1, "[1,1]").when(k % 5 == 2, "[0]").when(k % 5 == 3, "[]").otherwise("[1, 4]"),
        "ocr.word_confidence_summary": join('{"mean_percent":', n, ',"word_count":3}'), "multimodal.uncertain_spans": join('["', F.repeat(F.lit("x"), n.cast("int")), '"]'), "other.signal": F.lit("true"),
    }
    signals = F.explode(F.array(*[F.struct(F.lit(a).alias("key"), b.alias("payload")) for a, b in payload.items()]))
    s = t("documents").where("n_chars is not null").select("doc_id", signals.alias("s")).select("doc_id", "s.*")
    return s.select("doc_id", "key", quality.signal_problem(C("key"), F.lit("v1"), C("payload")).alias("problem"))


_POLICY = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS outcome, doc_id % 4 AS cap, coalesce(n_chars, 0) > 0 AS filled, coalesce(n_chars, 0) >= 300 AS good, doc_id % 5 < 3 AS more FROM documents"""


def _policy(t):
    k, n = C("doc_id"), F.coalesce("n_chars", F.lit(0))
    word = lambda c: F.when(c, "true").otherwise("false")
    signals = F.create_map(
        F.lit("core.output_nonempty"), word(n > 0), F.lit("native.page_text_present"), word(n >= 300), F.lit("ocr.needs_visual_review"), word(n < 300), F.lit("multimodal.schema_valid"), word(n >= 300), F.lit("multimodal.uncertain_span_count"), F.lit("0"))
    outcome, available = F.when(k % 11 == 0, "failed").otherwise("completed"), F.when(k % 5 < 3, F.array(F.lit("ocr"), F.lit("visual_transcribe"))).otherwise(F.array().cast("array<string>"))
    return lambda capability: quality.document_policy(outcome, capability, signals, n > 0, available)


@query(f"""WITH p AS ({_POLICY}), q AS (SELECT *, CASE cap WHEN 0 THEN 'text_extract' WHEN 1 THEN 'ocr' WHEN 2 THEN 'visual_transcribe' ELSE 'table' END AS c FROM p)
SELECT doc_id, CASE WHEN outcome = 'failed' THEN 'quarantine_review' WHEN cap = 3 THEN CASE WHEN filled THEN 'accept' ELSE 'quarantine_review' END WHEN good THEN 'accept' WHEN cap < 2 AND more THEN 'escalate' ELSE 'quarantine_review' END AS decision,
CASE WHEN outcome = 'failed' THEN 'processor_failed' WHEN cap = 3 THEN CASE WHEN filled THEN 'generic_output_present' ELSE 'no_accepted_policy_rule' END
WHEN cap = 0 THEN CASE WHEN good THEN 'native_text_present' WHEN more THEN 'native_text_missing_or_suspicious' ELSE 'ocr_unavailable' END
WHEN cap = 1 THEN CASE WHEN good THEN 'ocr_accepted' WHEN more THEN 'ocr_requires_visual' ELSE 'visual_escalation_unavailable' END ELSE CASE WHEN good THEN 'visual_transcription_valid' ELSE 'visual_transcription_uncertain' END END AS reason,
CASE WHEN outcome <> 'failed' AND NOT good AND more AND cap < 2 THEN CASE cap WHEN 0 THEN 'ocr' ELSE 'visual_transcribe' END END AS next FROM q""")
def document_policy(t):
    capability = F.element_at(F.array(*map(F.lit, ("text_extract", "ocr", "visual_transcribe", "table"))), (C("doc_id") % 4 + 1).cast("int"))
    return t("documents").select("doc_id", _policy(t)(capability).alias("d")).select("doc_id", "d.*")


@query(f"""WITH p AS ({_POLICY}) SELECT doc_id, CASE WHEN outcome = 'failed' OR good OR NOT more THEN 'text_extract' ELSE 'visual_transcribe' END AS step, CASE WHEN outcome = 'failed' THEN 'quarantine_review' WHEN good THEN 'accept' ELSE 'quarantine_review' END AS decision,
CASE WHEN outcome = 'failed' OR good OR NOT more THEN 1 ELSE 3 END AS taken FROM p""")
def escalation_ladder(t):
    of = _policy(t)
    ended = quality.escalation_ladder(t("documents"), [(c, of(F.lit(c))) for c in ("text_extract", "ocr", "visual_transcribe")])
    return ended.select("doc_id", "ended.step", "ended.decision", "ended.taken")


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'failed' ELSE 'completed' END AS outcome, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'insufficient_evidence' WHEN event_id % 3 = 0 THEN 'supported' ELSE 'contradicted' END AS verdict,
CASE WHEN event_id % 13 = 0 AND event_id % 2 = 0 THEN 'derivation_program_mismatch' WHEN event_id % 13 = 0 THEN 'unsupported_consumed_result' WHEN event_id % 7 = 0 THEN 'derivation_not_source_backed' END AS code FROM events""")
def scalar_verification(t):
    k = C("event_id")
    kind, program = F.when(k % 13 == 0, "table").otherwise("scalar"), F.when((k % 13 == 0) & (k % 2 == 0), "b").otherwise("a")
    cell = lambda n: F.struct(F.lit("integer").alias("type"), n.cast("string").alias("value"))
    v = quality.scalar_verdict(cell(k), cell(F.when(k % 3 == 0, k).otherwise(k + 1)), kind, F.when(k % 7 == 0, "none").otherwise("partial"), program, F.lit("a"))
    return t("events").select("event_id", v.alias("v")).select("event_id", "v.*")


@query("""SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 5 = 0 AND n > 0 THEN 'unknown_query' WHEN o_orderkey % 3 < 2 AND n = 0 THEN 'nothing_cited' WHEN o_orderkey % 3 < 2 AND good = 0 THEN 'not_source_backed' END AS problem FROM (
SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS good FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
WHERE (o_orderkey % 5 = 0 AND n > 0) OR (o_orderkey % 3 < 2 AND (n = 0 OR good = 0))""")
def verdict_consistency(t):
    line = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    queries = t("lineitem").groupBy(line.alias("query_id"), C("l_orderkey").alias("case_id")).agg(F.bool_or(C("l_returnflag") == "R").alias("ok"), F.bool_or(C("l_linestatus") == "O").alias("source_backed"))
    cited = queries.groupBy("case_id").agg(F.collect_list(F.when(C("case_id") % 5 == 0, F.concat(F.lit("x"), "query_id")).otherwise(C("query_id"))).alias("cited"))
    verdict = F.element_at(F.array(*map(F.lit, ("supported", "contradicted", "insufficient_evidence"))), (C("o_orderkey") % 3 + 1).cast("int"))
    verdicts = t("orders").select(C("o_orderkey").alias("case_id"), verdict.alias("verdict")).join(cited, "case_id", "left")
    return quality.verdict_problems(verdicts, queries)


# --- audits of published data sets


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'metadata_only' WHEN o_orderkey % 9 = 1 THEN 'api_error_persistent' WHEN o_orderkey % 9 = 2 THEN 'source_file_only' WHEN o_orderkey % 9 = 3 THEN 'complete_verified' WHEN o_orderkey % 9 = 4 THEN 'partial_known_limit'
WHEN o_orderkey % 9 = 5 THEN 'partial_possible_truncation' ELSE 'complete_probable' END AS status, CASE WHEN o_orderkey % 9 IN (0, 1, 3) THEN 'high' WHEN o_orderkey % 9 = 8 THEN 'low' ELSE 'medium' END AS confidence,
CASE WHEN o_orderkey % 9 IN (3, 6, 7, 8) THEN 'yes' WHEN o_orderkey % 9 IN (2, 4, 5) THEN 'only_with_caution' ELSE 'no' END AS usable FROM orders""")
def completeness(t):
    k = C("o_orderkey") % 9
    audit = F.when(k == 0, "metadata_only").when(k < 3, "datastream_failed_or_empty").otherwise("usable_datastream")
    resolution = F.when(k == 3, "complete_verified_by_source_file").when(k == 4, "something_else")
    rows = F.when(k.isin(3, 5, 6), 1000).when(k == 7, 12)
    d = quality.completeness(audit, k == 4, rows, resolution, F.when(k == 2, "recovered_source_file"), F.when(k == 6, 5), [999, 1000], F.lit(None).cast("string"))
    return t("orders").select("o_orderkey", d.alias("d")).select("o_orderkey", "d.status", "d.confidence", quality.usable(C("d.status")).alias("usable"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_size + 1 > p_partkey % 40 AND p_size + 1 > p_size THEN 'complete_verified_by_source_file' WHEN p_size % 3 = 0 AND p_partkey % 40 > p_size THEN 'complete_verified_by_csv_or_xlsx'
WHEN p_partkey % 5 = 0 THEN 'partial_possible_truncation_server_repeats_payload' ELSE 'partial_known_api_limit_source_unavailable' END AS status FROM part""")
def truncation_resolution(t):
    api, csv = C("p_size"), F.when(C("p_size") % 3 == 0, (C("p_partkey") % 40).cast("int"))
    source = F.when((C("p_size") % 4 == 0) & (C("p_size") + 1 > C("p_partkey") % 40), C("p_size") + 1)
    return t("part").select("p_partkey", quality.truncation_resolution(api, csv, F.lit(None).cast("int"), source, C("p_partkey") % 5 == 0, F.lit(False)).alias("status"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'usable_datastream' WHEN user_id % 3 = 0 THEN 'endpoint_only' WHEN bool_or(event_type = 'error') THEN 'possible_truncation' ELSE 'datastream_failed_or_empty' END AS status FROM events GROUP BY user_id""")
def audit_status(t):
    s = F.when(C("event_type") == "purchase", "ok").when(C("event_type") == "error", "possible_truncation_repeated_payload").otherwise("failed")
    per = t("events").groupBy("user_id").agg(F.collect_set(s).alias("statuses"))
    return per.select("user_id", quality.audit_status(C("statuses"), F.when(C("user_id") % 3 == 0, "skipped_existing")).alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 500 + 100 BETWEEN 200 AND 299 THEN 'success' WHEN event_id % 500 + 100 IN (404, 410) THEN 'not_found' ELSE 'failed' END AS outcome FROM events")
def http_outcome(t):
    return t("events").select("event_id", quality.http_outcome(C("event_id") % 500 + 100).alias("outcome"))


@query("""SELECT p_partkey, CASE WHEN p_size > 45 THEN 'retry' WHEN n > 1 THEN 'functional_duplicate' ELSE 'manual' END AS class FROM (SELECT *, count(*) OVER (PARTITION BY lower(p_name), p_brand) AS n FROM part) WHERE p_size > 40""")
def failed_resources(t):
    p = t("part")
    key = F.concat_ws("\x1f", F.lower("p_name"), "p_brand")
    twins = relational.duplicates(p, key, "p_partkey").select("key", "n")
    failed = p.where("p_size > 40").withColumn("key", key).join(twins, "key", "left")
    return failed.select("p_partkey", F.when(C("p_size") > 45, "retry").when(C("n").isNotNull(), "functional_duplicate").otherwise("manual").alias("class"))


@query("""SELECT page, id, value FROM (SELECT event_id // 100 AS page, user_id AS id, event_id AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def first_seen(t):
    e = t("events").select(F.floor(C("event_id") / 100).alias("page"), C("user_id").alias("id"), C("event_id").alias("value"))
    return e.groupBy("id").agg(F.min_by(F.struct("page", "value"), F.struct("page", "value")).alias("f")).select("f.page", "id", "f.value")


# --- review and claim control


@query("""WITH e AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, CASE WHEN event_type = 'click' AND s = 'active' THEN 'restricted' WHEN event_type = 'view' AND s = 'restricted' THEN 'active' WHEN event_type = 'purchase' AND s IN ('active', 'restricted') THEN 'retracted' END AS state
FROM (SELECT *, CASE before WHEN 'click' THEN 'restricted' WHEN 'purchase' THEN 'retracted' ELSE 'active' END AS s FROM e)""")
def lifecycle_transition(t):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    state = F.when(C("b") == "click", "restricted").when(C("b") == "purchase", "retracted").otherwise("active")
    action = F.when(C("event_type") == "click", "restrict").when(C("event_type") == "view", "unrestrict").when(C("event_type") == "purchase", "retract").otherwise("other")
    return t("events").withColumn("b", before).select("event_id", review.next_lifecycle(state, action).alias("state"))


@query("""SELECT doc_id, quality IS NULL AND doc_id % 3 < 2 AS machine_only, quality IS NOT NULL AS human_reviewed, quality IS NULL AND doc_id % 3 = 2 AS unreviewed_human, coalesce(quality = 1 AND doc_id % 2 = 0 AND doc_id % 5 <> 0, false) AS strict_ready
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)""")
def review_state(t):
    d = t("documents").select("doc_id").distinct().join(t("labels").groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id", "left")
    origin = F.element_at(F.array(F.lit("machine"), F.lit("rule"), F.lit("human")), (C("doc_id") % 3 + 1).cast("int"))
    s = review.review_state(origin, C("doc_id") % 2 == 0, F.when(C("doc_id") % 5 == 0, "restricted").otherwise("active"), F.when(C("q") == 1, "accepted").when(C("q") == 0, "rejected"))
    return d.select("doc_id", s.alias("s")).select("doc_id", "s.*")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3 OR sha256('{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}') <> sha256('{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}')""")
def snapshot_stale(t):
    h = lambda s: review.snapshot_hash(F.struct(C("o_orderkey").alias("k"), s.alias("s")))
    seen = t("orders").select("o_orderkey", h(C("o_orderstatus")).alias("h"))
    now = t("orders").select("o_orderkey", h(F.when(C("o_orderkey") % 10 == 3, "changed").otherwise(C("o_orderstatus"))).alias("h"))
    return review.stale(seen, now, "o_orderkey", "h").select("o_orderkey")


@query("""SELECT o_custkey, sha256('[' || string_agg('"' || k || '"', ',' ORDER BY k) || ']') AS fingerprint, count(*) AS members FROM (SELECT DISTINCT o_custkey, o_orderkey::VARCHAR AS k FROM orders) GROUP BY o_custkey""")
def batch_fingerprint(t):
    return review.fingerprint(t("orders"), ["o_custkey"], "o_orderkey")


@query("""SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' END, 'deferred') AS decision FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)""")
def batch_decisions(t):
    o = t("labels").groupBy("doc_id").agg(F.min("quality").alias("q")).select("doc_id", F.when(C("q") == 1, "accepted").when(C("q") == 0, "rejected").alias("decision"))
    return review.batch_decisions(t("documents").select("doc_id").distinct(), o, "doc_id", F.lit("deferred"))


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IS NOT NULL)")
def batch_strays(t):
    return review.strays(t("documents").where("lang = 'en'"), t("labels"), "doc_id").select("doc_id").distinct()


@query("""SELECT l_orderkey + 1000000 AS l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linenumber <= 2""")
def copy_forward(t):
    chosen = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), (C("o_orderkey") + 1000000).alias("new"))
    chosen = chosen.select(C("o_orderkey").alias("l_orderkey"), C("n").alias("l_linenumber"), "new")
    return review.copy_forward(t("lineitem"), chosen, "l_orderkey", "l_linenumber", "new").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT event_id, user_id FROM events WHERE event_id % 4 <> 0 AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def review_append(t):
    subjects, evidence = t("customer").where("c_acctbal > 0").select(C("c_custkey").alias("user_id")), t("orders").where("o_orderstatus = 'O'").select(C("o_custkey").alias("user_id"))
    return review.appendable(t("events"), subjects, evidence, t("events").where("event_id % 4 = 0"), "event_id", "user_id").select("event_id", "user_id")


@query("""SELECT user_id, event_type, event_id, n AS chain_length FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WINDOW w AS (PARTITION BY user_id, event_type)) WHERE rn = 1""")
def assessment_chain(t):
    return review.latest_assessment(t("events"), ["user_id", "event_type"], [C("ts"), C("event_id")]).select("user_id", "event_type", "event_id", "chain_length")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey % 50 <= l.l_quantity AND o.o_orderkey % 50 + 20 >= l.l_quantity + 1)""")
def derivation_scope(t):
    scopes = t("orders").select(C("o_orderkey").alias("l_orderkey"), (C("o_orderkey") % 50).alias("lo"), (C("o_orderkey") % 50 + 20).alias("hi"))
    return review.uncontained(t("lineitem"), scopes, ["l_orderkey"], (C("lo") <= C("l_quantity")) & (C("hi") >= C("l_quantity") + 1)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH r AS (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders UNION SELECT user_id FROM events UNION SELECT s_suppkey FROM supplier)) SELECT c_custkey, c_custkey NOT IN (SELECT c_custkey FROM r) AS orphan FROM customer""")
def referenced_objects(t):
    owners = [t("orders").select(C("o_custkey").alias("k")), t("events").select(C("user_id").alias("k")), t("supplier").select(C("s_suppkey").alias("k"))]
    alive = review.referenced(owners, "k").withColumn("alive", F.lit(True))
    return t("customer").join(alive, C("c_custkey") == C("k"), "left").select("c_custkey", C("alive").isNull().alias("orphan"))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN NULL ELSE source END AS source, n_chars FROM documents")
def purge_scrub(t):
    return review.scrubbed(t("documents").select("doc_id", "source", "n_chars"), t("labels").where("toxic = 1"), "doc_id", ["source"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def in_subquery_delete(t):
    return t("lineitem").join(t("orders").where("o_orderstatus = 'P'"), C("l_orderkey") == C("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


# --- routing and gates

_PROCESSORS = (
    ("native", 1, "text_extract", ["text/html", "application/pdf"], ["whole", "pdf_page"], 2000, False),
    ("remote", 2, "text_extract", ["text/html"], ["whole", "pdf_page", "media"], None, True),
    ("table", 3, "table_extract", ["text/csv"], ["whole"], 900, False),
)
_ROUTE_SQL = """WITH r AS (SELECT doc_id, doc_id % 3 AS m, doc_id % 2 AS c, doc_id % 5 AS k, coalesce(n_chars, 0) AS n FROM documents), e AS (
SELECT doc_id, 'native' AS p, 1 AS o, 'text_extract' AS c FROM r WHERE m < 2 AND k < 3 AND n <= 2000 UNION ALL SELECT doc_id, 'remote', 2, 'text_extract' FROM r WHERE m = 0 AND doc_id % 7 <> 0 AND doc_id % 4 > 0 UNION ALL SELECT doc_id, 'table', 3, 'table_extract' FROM r WHERE m = 2 AND k < 2 AND n <= 900)"""


def _requests(t, capability):
    k, pick = C("doc_id"), lambda x, n: F.element_at(F.array(*map(F.lit, x)), (n + 1).cast("int"))
    kinds = F.when(k % 5 < 2, F.array(F.lit("whole"))).when(k % 5 == 2, F.array(F.lit("whole"), F.lit("pdf_page"))).otherwise(F.array(F.lit("media")))
    return t("documents").select(
        k.alias("request_id"), capability(pick).alias("capability"), pick(("text/html", "application/pdf", "text/csv"), k % 3).alias("media"), kinds.alias("kinds"), F.coalesce("n_chars", F.lit(0)).alias("bytes"),
        (k % 7 == 0).alias("restricted"), (k % 4 > 0).alias("egress_allowed"))


def _processors(df):
    return df.sparkSession.createDataFrame(_PROCESSORS, "processor string, position int, p_capability string, p_media array<string>, p_kinds array<string>, p_bytes int, p_egress boolean")


@query(_ROUTE_SQL + " SELECT DISTINCT e.doc_id AS request_id, first_value(p) OVER (PARTITION BY e.doc_id ORDER BY o) AS processor FROM e JOIN r ON r.doc_id = e.doc_id WHERE e.c = CASE r.c WHEN 0 THEN 'text_extract' ELSE 'table_extract' END")
def route_first(t):
    r = _requests(t, lambda pick: pick(("text_extract", "table_extract"), C("doc_id") % 2))
    return review.routed(review.eligible(r, _processors(r)))


@query(_ROUTE_SQL + " SELECT doc_id AS request_id, string_agg(DISTINCT c, ',' ORDER BY c) AS capabilities FROM e GROUP BY doc_id")
def available_capabilities(t):
    r = _requests(t, lambda pick: F.lit(""))
    every = r.drop("capability").withColumn("capability", F.explode(F.array(F.lit("text_extract"), F.lit("table_extract"))))
    got = review.eligible(every, _processors(r)).join(F.broadcast(_processors(r).select("processor", "p_capability")), "processor")
    return got.groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_set("p_capability")), ",").alias("capabilities"))


@query("""SELECT n_name AS capability, CASE WHEN bool_or(o_orderstatus = 'F' AND o_totalprice > 460000) THEN 'failed' WHEN bool_or(o_orderstatus = 'O') THEN 'verified' WHEN count(o_orderkey) > 0 THEN 'pending' ELSE 'missing' END AS state
FROM nation LEFT JOIN (customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000) ON n_nationkey = c_nationkey GROUP BY n_name""")
def capability_gate(t):
    status = F.when((C("o_orderstatus") == "F") & (C("o_totalprice") > 460000), "failed").when(C("o_orderstatus") == "O", "verified").otherwise("pending")
    cases = t("orders").where("o_totalprice > 300000").join(t("customer"), C("o_custkey") == C("c_custkey")).join(t("nation"), C("c_nationkey") == C("n_nationkey")).select(F.array("n_name").alias("covers"), status.alias("status"))
    return review.coverage_gate(t("nation").select(C("n_name").alias("capability")), cases, "capability", "covers", "status")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def bounded_queue(t):
    return relational.bounded_queue(t("orders").where("o_orderstatus = 'O'"), [C("o_orderdate"), C("o_orderkey")], 200).select("o_orderkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY v ASC NULLS FIRST, p_partkey) AS up, row_number() OVER (ORDER BY v DESC NULLS LAST, p_partkey) AS down FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS v FROM part WHERE p_size < 20)")
def null_order(t):
    v = F.when(C("p_size") % 5 != 0, C("p_size"))
    up, down = Window.orderBy(v.asc(), "p_partkey"), Window.orderBy(v.desc(), "p_partkey")
    return t("part").where("p_size < 20").select("p_partkey", F.row_number().over(up).alias("up"), F.row_number().over(down).alias("down"))


# --- scores and reports


@query("""SELECT c_custkey, coalesce(o.n, 0) AS sources, coalesce(e.n, 0) AS targets, CASE WHEN coalesce(o.n, 0) >= 2 AND coalesce(e.n, 0) = 1 THEN 'merge' WHEN coalesce(o.n, 0) = 1 AND coalesce(e.n, 0) >= 2 THEN 'split' ELSE 'other' END AS kind
FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON o.k = c_custkey LEFT JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) e ON e.k = c_custkey""")
def merge_split(t):
    return relational.merge_split(t("customer"), t("orders"), t("events"), "c_custkey", "o_custkey", "user_id")


@query("SELECT w AS entity, count(*) AS documents FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part) WHERE w <> '' GROUP BY w")
def entity_document_frequency(t):
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "), lambda w: w != ""))
    return t("part").select(F.explode(words).alias("entity")).groupBy("entity").agg(F.count("*").alias("documents"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), b AS (SELECT w[i] || ' ' || w[i + 1] AS bigram FROM w, range(1, 9) r(i) WHERE i < len(w)) SELECT bigram, count(*) AS n FROM b GROUP BY bigram ORDER BY n DESC, bigram LIMIT 1""")
def top_bigram(t):
    return text.bigrams(t("part"), C("p_name")).groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(1)


@query("""SELECT lang AS capability, count(*) FILTER (WHERE quality = 1 AND n_chars >= 500) / count(*) FILTER (WHERE quality = 1)::DOUBLE AS recall FROM documents JOIN labels USING (doc_id) GROUP BY lang HAVING count(*) FILTER (WHERE quality = 1) > 0""")
def capability_recall(t):
    j = t("documents").join(t("labels"), "doc_id").withColumn("capability", F.explode(F.array("lang")))
    return quality.precision_recall(j, C("quality") == 1, C("n_chars") >= 500, ["capability"]).where("recall is not null").select("capability", "recall")


@query("""SELECT count(*) AS n, avg((quality = g)::INT) AS accuracy, count(*) FILTER (WHERE g = 0 AND quality = 0) / count(*) FILTER (WHERE g = 0)::DOUBLE AS precision, count(*) FILTER (WHERE g = 0 AND quality = 0) / count(*) FILTER (WHERE quality = 0)::DOUBLE AS recall
FROM (SELECT quality, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS g FROM documents JOIN labels USING (doc_id))""")
def verdict_metrics(t):
    name = lambda c: F.when(c, "supported").otherwise("insufficient_evidence")
    j = t("documents").join(t("labels"), "doc_id")
    return quality.abstention_scores(j, name(C("quality") == 1), name(C("n_chars") >= 300))


@query("SELECT o_orderstatus AS state, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY o_orderstatus")
def progress_counts(t):
    return t("orders").groupBy(C("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.count_if(C("o_totalprice") > 200000).alias("large"))


@query("""SELECT count(DISTINCT l_orderkey) AS sheets, count(*) AS rows, 3 * count(*) AS cells, count(*) * 2 + count(*) FILTER (WHERE l_discount > 0) AS filled, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds FROM lineitem""")
def manifest_stats(t):
    return t("lineitem").agg(F.countDistinct("l_orderkey").alias("sheets"), F.count("*").alias("rows"), (F.count("*") * 3).alias("cells"), (F.count("*") * 2 + F.count_if(C("l_discount") > 0)).alias("filled"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("kinds"))


@query("""SELECT conv_id, avg((coalesce(length(text), 0) > 0)::INT) AS coverage, count(*) FILTER (WHERE coalesce(length(text), 0) < 100) AS n_short, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE coalesce(length(text), 0) < 100), '') AS short_turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def page_stats(t):
    n = F.coalesce(F.length("text"), F.lit(0))
    short = F.array_sort(F.collect_list(F.when(n < 100, C("turn"))))
    return t("conversations").groupBy("conv_id").agg(F.avg((n > 0).cast("int")).alias("coverage"), F.count_if(n < 100).alias("n_short"), F.array_join(short, ",").alias("short_turns"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT 'orders' AS family, o_custkey AS parent, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'events', user_id, count(*) FROM events GROUP BY 2""")
def family_counts(t):
    return relational.family_counts({"orders": (t("orders"), "o_custkey"), "events": (t("events"), "user_id")})


@query("""SELECT l_returnflag AS metric, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') - sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS delta FROM lineitem GROUP BY l_returnflag""")
def system_delta(t):
    per = t("lineitem").groupBy(C("l_returnflag").alias("metric"), C("l_linestatus").alias("system")).agg(F.sum("l_quantity").alias("value"))
    return relational.system_delta(per, "metric", "system", "value", "F", "O")


@query("""SELECT o_custkey, max((o_orderstatus = 'F')::INT) AS f, max((o_orderstatus = 'O')::INT) AS o, max((o_orderstatus = 'P')::INT) AS p FROM orders GROUP BY o_custkey""")
def membership_matrix(t):
    return relational.membership(t("orders"), ["o_custkey"], "o_orderstatus", {"F": "f", "O": "o", "P": "p"})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size IS NOT NULL THEN p_size::DOUBLE ELSE l_quantity END AS value FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 40""")
def cell_mutation(t):
    patch = t("part").where("p_size > 40").select(C("p_partkey").alias("l_partkey"), C("p_size").cast("double").alias("patch"))
    return relational.patched(t("lineitem").withColumn("value", C("l_quantity")), patch, ["l_partkey"], "value", "patch").select("l_orderkey", "l_linenumber", "l_partkey", "value")


@query("""SELECT 'orderstatus' AS vocabulary, o_orderstatus AS value FROM (SELECT DISTINCT o_orderstatus FROM orders) WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'event_type', event_type FROM (SELECT DISTINCT event_type FROM events) WHERE event_type NOT IN ('view', 'click')""")
def closed_vocabulary(t):
    return quality.outside_vocabulary({"orderstatus": (t("orders"), "o_orderstatus", ["F", "O"]), "event_type": (t("events"), "event_type", ["view", "click"])})


@query("""SELECT n_nationkey, n_regionkey FROM (SELECT n.n_nationkey, n.n_regionkey FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_regionkey < 3 WHERE r.r_regionkey IS NULL)""")
def evidence_refs(t):
    return t("nation").join(t("region").where("r_regionkey < 3"), C("n_regionkey") == C("r_regionkey"), "left_anti").select("n_nationkey", "n_regionkey")


@query("""WITH a AS (SELECT 'n' AS col, n_nationkey AS v FROM nation UNION ALL SELECT 'r', n_regionkey FROM nation UNION ALL SELECT 's', s_nationkey FROM supplier) SELECT x.col AS a, y.col AS b, min(x.v) AS first FROM a x JOIN a y ON x.v = y.v AND x.col < y.col GROUP BY 1, 2""")
def first_overlap(t):
    cells = t("nation").select(F.explode(F.array(F.struct(F.lit("n").alias("col"), C("n_nationkey").alias("v")), F.struct(F.lit("r").alias("col"), C("n_regionkey").alias("v")))).alias("c")).select("c.*")
    return relational.first_overlap(cells.unionByName(t("supplier").select(F.lit("s").alias("col"), C("s_nationkey").alias("v"))), "col", "v")


# --- words, names and routes


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_brand = '' THEN p_type ELSE p_brand END ELSE p_name END AS value FROM part""")
def first_filled(t):
    return t("part").select("p_partkey", text.first_filled(F.when(C("p_size") % 4 == 0, "").otherwise(C("p_name")), C("p_brand"), C("p_type")).alias("value"))


@query("""SELECT doc_id, contains(lower(text), 'password') OR contains(lower(text), 'email') AS pii FROM documents WHERE text IS NOT NULL""")
def pii_terms(t):
    return t("documents").where("text is not null").select("doc_id", text.mentions(C("text"), ["Password", "EMAIL"]).alias("pii"))


@query("""SELECT p_partkey, CASE upper(p_type) WHEN 'ECONOMY' THEN 'cheap' WHEN 'PROMO' THEN 'sale' ELSE 'other' END AS category FROM part""")
def category_map(t):
    return t("part").select("p_partkey", text.mapped(C("p_type"), {"economy": "cheap", "Promo": "sale"}, "other").alias("category"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'none' WHEN b > a AND b > 0 THEN 'second' WHEN a > 0 THEN 'first' ELSE 'none' END AS route FROM (SELECT doc_id, text, (contains(lower(text), 'the '))::INT + (contains(lower(text), ' of '))::INT AS a,
(contains(lower(text), ' de '))::INT + (contains(lower(text), ' la '))::INT + (contains(lower(text), ' les '))::INT AS b FROM documents WHERE text IS NOT NULL)""")
def route_signals(t):
    got = text.route(C("text"), {"first": ["the ", " of "], "second": [" de ", " la ", " les "]}, ["license"])
    return t("documents").where("text is not null").select("doc_id", F.coalesce(got, F.lit("none")).alias("route"))


@query("""SELECT p_partkey, ([x for x in string_split(lower(p_name || ' ' || p_type || ' of the'), ' ') if length(x) >= 4 AND x NOT IN ('ring', 'small')])[1:3]::VARCHAR AS words FROM part""")
def name_tokens(t):
    got = text.name_tokens(F.concat_ws(" ", "p_name", "p_type", F.lit("of the")), ["ring", "small"], 4, 3)
    return t("part").select("p_partkey", F.concat(F.lit("["), F.array_join(got, ", "), F.lit("]")).alias("words"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'look' ELSE event_type END AS category, event_type IN ('view', 'click') AS valid FROM events""")
def category_fix(t):
    fixed = text.mapped(C("event_type"), {"view": "look"}, None)
    fixed = F.coalesce(fixed, C("event_type"))
    return t("events").select("event_id", fixed.alias("category"), fixed.isin("look", "click").alias("valid"))


@query(r"SELECT p_partkey, trim(regexp_replace(p_name, '\s+', ' ', 'g')) || chr(31) || p_brand AS key FROM part")
def episode_key(t):
    return t("part").select("p_partkey", text.episode_key(C("p_name"), C("p_brand")).alias("key"))


@query("""SELECT doc_id, 1 + length(text) - length(replace(text, chr(10), '')) AS lines, string_split(text, chr(10))[1] AS title FROM documents WHERE text IS NOT NULL""")
def announcement_titles(t):
    lines = F.split("text", "\n")
    return t("documents").where("text is not null").select("doc_id", F.size(lines).cast("bigint").alias("lines"), F.get(lines, F.lit(0)).alias("title"))


# --- sources in text and JSON


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def api_envelopes(t):
    wrap = [("", ""), ('{"results":', "}"), ('{"result":{"records":', "}}"), ('{"data":', ',"total":1}')]
    payload = F.lit(None).cast("string")
    for n, (a, b) in enumerate(wrap):
        payload = F.when(C("event_id") % 4 == n, F.concat(F.lit(f"{a}["), C("props"), F.lit(f"]{b}"))).otherwise(payload)
    got = tables.unwrapped(payload, "struct<k: bigint>")
    return t("events").select("event_id", F.explode(got).alias("r")).select("event_id", "r.k")


@query("SELECT o_orderkey, o_orderstatus AS status, o_custkey::VARCHAR AS customer FROM orders WHERE o_orderkey % 3 > 0")
def list_of_lists(t):
    body = F.concat(F.lit('[["status","customer"],["'), C("o_orderstatus"), F.lit('","'), C("o_custkey").cast("string"), F.lit('"]]'))
    payload = F.when(C("o_orderkey") % 3 == 0, '{"status":1}').otherwise(body)
    got = t("orders").select("o_orderkey", F.explode(tables.list_of_lists(payload)).alias("r"))
    return got.select("o_orderkey", C("r")["status"].alias("status"), C("r")["customer"].alias("customer"))


@query("""WITH p AS (SELECT user_id, row_number() OVER w AS page, event_type = lag(event_type) OVER w AS again FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, min(page) FILTER (WHERE again) AS stop, count(*) AS n FROM p GROUP BY user_id)
SELECT user_id, coalesce(stop - 1, n) AS pages, stop IS NOT NULL AS repeated, coalesce(stop - 1, n) IN (2, 5) AS at_boundary FROM s""")
def repeated_pages(t):
    e = t("events").select("user_id", F.struct("ts", "event_id").alias("page"), "event_type")
    return tables.pages_until_repeat(e, "user_id", "page", "event_type", [2, 5])


@query("SELECT f AS file, count(*) AS sheets, sum(n - 1)::BIGINT AS data_rows, max(n) AS most, CASE WHEN sum(n - 1) > 0 THEN 'has_data' ELSE 'empty' END AS status FROM (SELECT l_orderkey % 500 AS f, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY f")
def workbook_audit(t):
    sheets = t("lineitem").groupBy((C("l_orderkey") % 500).alias("file"), "l_linenumber").agg(F.count("*").alias("rows"))
    return tables.workbook_audit(sheets, "file", "rows")


@query(r"SELECT conv_id, role || ' ' || turn AS heading, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (SELECT conv_id, role, turn, unnest(string_split(replace(text, '## ', '## '), chr(10))) AS line FROM conversations WHERE text IS NOT NULL) GROUP BY 1, 2")
def markdown_episodes(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), C("role"), F.lit(" "), C("turn").cast("string"), F.lit("\n"), C("text")).alias("s"))))
    md = t("conversations").where("text is not null").groupBy("conv_id").agg(F.concat(F.lit("# top\n"), F.array_join(F.transform(turns, lambda x: x["s"]), "\n")).alias("md"))
    return text.markdown_sections(md, "conv_id", C("md")).groupBy("conv_id", "heading").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Order ' || o_orderkey AS title FROM orders")
def bulletin_announcements(t):
    line = F.concat(F.lit("- "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(": Order "), C("o_orderkey").cast("string"))
    doc = t("orders").groupBy("o_custkey").agg(F.concat(F.lit("intro\n- 2000-01-01: no\n## Notices\n"), F.concat_ws("\n", F.collect_list(line)), F.lit("\n## Other\n- 2001-01-01: not this\n")).alias("md"))
    return doc.select("o_custkey", F.explode(text.bulletin_items(C("md"), "Notices")).alias("i")).select("o_custkey", "i.date", "i.title")


# --- index, tables in text, reports


@query("""SELECT DISTINCT d.doc_id FROM documents d WHERE d.lang = 'en' AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'license')""")
def index_search(t):
    eligible = t("documents").where("lang = 'en'").join(t("labels").where("toxic = 1"), "doc_id", "left_anti")
    return text.search_index(text.token_index(eligible, "doc_id", C("text")), "doc_id", ["The", "license"])


@query("""SELECT 'missing' AS side, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en' AND regexp_matches(text, '[\\p{L}\\p{N}]') EXCEPT SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 6 <> 0) UNION ALL
SELECT 'extra', count(*) FROM (SELECT DISTINCT doc_id FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 6 <> 0 AND regexp_matches(text, '[\\p{L}\\p{N}]') EXCEPT SELECT doc_id FROM documents WHERE lang = 'en')""")
def index_coverage(t):
    eligible, indexed = t("documents").where("lang = 'en'"), t("documents").where("lang in ('en', 'fr') and doc_id % 6 <> 0")
    want, have = (text.token_index(x, "doc_id", C("text")).select("doc_id").distinct() for x in (eligible, indexed))
    status = relational.reconcile(want, have, "doc_id")
    return status.agg(F.count_if(C("status") == "missing").alias("m"), F.count_if(C("status") == "extra").alias("e")).select(F.explode(F.array(F.struct(F.lit("missing").alias("side"), C("m").alias("n")), F.struct(F.lit("extra").alias("side"), C("e").alias("n")))).alias("r")).select("r.*")


@query("""WITH x AS (SELECT p_partkey, p_partkey % 11 <> 0 AS there, p_size % 7 = 0 AS wrong FROM part) SELECT count(*) FILTER (WHERE there AND NOT wrong) / count(*)::DOUBLE AS row_recall, (count(*) FILTER (WHERE there) * 3 - count(*) FILTER (WHERE there AND wrong)) / (count(*) * 3)::DOUBLE AS cell_fidelity,
count(*) FILTER (WHERE there AND wrong) AS false_cells FROM x""")
def table_fidelity(t):
    p = t("part").select("p_partkey", "p_name", "p_brand", "p_size")
    seen = p.where("p_partkey % 11 <> 0").withColumn("p_brand", F.when(C("p_size") % 7 == 0, F.concat("p_brand", F.lit("?"))).otherwise(C("p_brand")))
    return quality.table_fidelity(p, seen, "p_partkey", ["p_name", "p_brand"])


@query(r"""WITH c AS (SELECT p_partkey, p_name || ', ' || p_brand || ' ' || p_name || 's' AS text, string_split(p_name, ' ') AS w FROM part), x AS (SELECT p_partkey, text, unnest(w || ['ring', 'ring', 'absent']) AS cell FROM c), k AS (SELECT p_partkey, text, cell, count(*) AS n FROM x GROUP BY ALL)
SELECT p_partkey, sum(least(n, len(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9#]+', '  ', 'g') || ' ', '(?:^| )' || cell || ' '))))::BIGINT / sum(n)::DOUBLE AS coverage FROM k GROUP BY p_partkey""")
def table_coverage(t):
    said = F.concat("p_name", F.lit(", "), "p_brand", F.lit(" "), "p_name", F.lit("s"))
    cells = F.concat(F.split("p_name", " "), F.array(F.lit("ring"), F.lit("ring"), F.lit("absent")))
    return t("part").select("p_partkey", text.covered_cells(said, cells).alias("coverage"))


@query("""SELECT c_custkey, array_to_string(list_sort([x for x in [CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_nationkey > 20 THEN 'nation' END, CASE WHEN length(c_name) > 17 THEN 'name' END] if x IS NOT NULL]), ',') AS errors FROM customer""")
def config_errors(t):
    e = quality.errors(debt=C("c_acctbal") < 0, nation=C("c_nationkey") > 20, name=F.length("c_name") > 17)
    return t("customer").select("c_custkey", F.array_join(e, ",").alias("errors"))


@query("""SELECT label, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([lang, source, CASE WHEN n_chars > 1000 THEN 'long' END, lang]) AS label FROM documents) WHERE label IS NOT NULL GROUP BY label""")
def multi_label_exploded(t):
    labels = F.array_distinct(F.array_compact(F.array("lang", "source", F.when(C("n_chars") > 1000, "long"), "lang")))
    return t("documents").select("doc_id", F.explode(labels).alias("label")).distinct().groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT event_id, count(*) OVER r AS n, min(event_id) OVER r AS lo, max(event_id) OVER r AS hi, (sum(value::DECIMAL(18,4)) OVER r)::DOUBLE AS total, round(avg(event_id) OVER r, 6) AS mean FROM events WINDOW r AS (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND 200 FOLLOWING)""")
def range_frames(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rangeBetween(-500, 200)
    v = C("value").cast("decimal(18,4)")
    return t("events").select("event_id", F.count("*").over(w).alias("n"), F.min("event_id").over(w).alias("lo"), F.max("event_id").over(w).alias("hi"), F.sum(v).over(w).cast("double").alias("total"), F.round(F.avg("event_id").over(w), 6).alias("mean"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_partkey - 500) // (p_size % 4) END AS q FROM part WHERE p_partkey >= 500")
def integer_division(t):
    return t("part").where("p_partkey >= 500").select("p_partkey", F.expr("(p_partkey - 500) div nullif(p_size % 4, 0)").alias("q"))


@query("""SELECT lower(trim(p_name)) || '|' || p_brand AS key, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1""")
def functional_duplicates_whole(t):
    return relational.duplicates(t("part"), F.concat_ws("|", F.lower(F.trim("p_name")), C("p_brand")), "p_partkey")


@query(r"""WITH w AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), c AS (SELECT item_id, w, count(*) AS n FROM w GROUP BY 1, 2), d AS (SELECT w, count(*) AS n FROM w WHERE item_id = 0 GROUP BY w)
SELECT item_id, coalesce(sum(CASE WHEN d.n IS NOT NULL THEN least(c.n, d.n) END), 0)::BIGINT AS shared, sum(greatest(c.n - coalesce(d.n, 0), 0))::BIGINT AS only FROM c LEFT JOIN d ON c.w = d.w GROUP BY item_id""")
def multiset_overlap(t):
    counts = t("benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("n"))
    base = counts.where("item_id = 0").select(C("w").alias("bw"), C("n").alias("bn"))
    met = counts.join(base, C("w") == C("bw"), "left")
    return met.groupBy("item_id").agg(F.coalesce(F.sum(F.when(C("bn").isNotNull(), F.least("n", "bn"))), F.lit(0)).alias("shared"), F.sum(F.greatest(C("n") - F.coalesce("bn", F.lit(0)), F.lit(0))).alias("only"))
