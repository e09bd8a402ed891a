"""Decisions and checks: typed signals, decision policies, verification, audits, result comparison, scores, violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import close_to, ratio

#: The registered quality signals by type.
SIGNALS = {
    "bool": ("core.output_nonempty", "native.page_text_present", "native.mixed_page_modes", "ocr.needs_visual_review", "multimodal.schema_valid"),
    "ratio": ("native.page_text_coverage", "native.replacement_character_ratio", "ocr.page_text_coverage", "multimodal.table_text_coverage"),
    "count": (
        "native.page_character_count", "native.page_raster_image_count", "native.selected_page_count", "native.empty_page_count", "ocr.page_character_count", "ocr.selected_page_count",
        "ocr.empty_page_count", "ocr.native_page_count", "ocr.ocr_page_count", "table.exact_row_count", "table.sheet_count", "media.duration_us", "multimodal.uncertain_span_count",
        "multimodal.transcription_character_count", "multimodal.table_count",
    ),
    "ordinals": ("native.empty_page_ordinals", "ocr.empty_page_ordinals", "ocr.ocr_page_ordinals"),
    "strings": ("multimodal.uncertain_spans",),
    "confidence": ("ocr.word_confidence_summary",),
}
#: Limits of signal payloads.
MAX_SIGNAL_BYTES, MAX_ORDINALS, MAX_STRINGS, MAX_STRING = 8192, 4096, 64, 512


def signal_problem(key: Column, version: Column, payload: Column) -> Column:
    """Null for a signal whose JSON payload fits its registered type, else unknown_signal, bad_payload or too_large."""
    of = F.lit(None).cast("string")
    for kind, keys in SIGNALS.items():
        of = F.when(key.isin(*keys) & (version == "v1"), kind).otherwise(of)
    number = F.when(payload.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), payload.try_cast("double"))
    whole = F.when(payload.rlike("^[0-9]+$"), payload.try_cast("bigint"))
    pages = F.when(payload.rlike(r"^\[\s*([0-9]+\s*(,\s*[0-9]+\s*)*)?\]$"), F.from_json(payload, "array<bigint>"))
    texts = F.when(payload.rlike(r"^\["), F.from_json(payload, "array<string>"))
    mean, words = (F.get_json_object(payload, f"$.{k}") for k in ("mean_percent", "word_count"))
    fits = (
        F.when(of == "bool", payload.isin("true", "false"))
        .when(of == "ratio", number.between(0, 1))
        .when(of == "count", whole >= 0)
        .when(of == "ordinals", (F.size(pages) <= MAX_ORDINALS) & F.forall(pages, lambda x: x >= 1) & (pages == F.array_sort(F.array_distinct(pages))))
        .when(of == "strings", (F.size(texts) <= MAX_STRINGS) & F.forall(texts, lambda x: F.length(x) <= MAX_STRING))
        .when(of == "confidence", (F.array_sort(F.json_object_keys(payload)) == F.array(F.lit("mean_percent"), F.lit("word_count"))) & mean.try_cast("double").between(0, 100) & words.rlike("^[0-9]+$"))
    )
    return F.when(of.isNull(), "unknown_signal").when(~F.coalesce(fits, F.lit(False)), "bad_payload").when(F.octet_length(payload) > MAX_SIGNAL_BYTES, "too_large")


def _verdict(decision: str, reason: str, following: str | None = None) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), F.lit(following).cast("string").alias("next"))


def document_policy(outcome: Column, capability: Column, signals: Column, has_output: Column, available: Column) -> Column:
    """The document-processing policy: struct (decision, reason, next). ``signals`` is a map of key to JSON text,
    ``available`` an array of capabilities. A signal that is missing is not true, not false and not zero."""
    is_ = lambda k, v: F.coalesce(F.try_element_at(signals, F.lit(k)) == v, F.lit(False))
    output = is_("core.output_nonempty", "true") & has_output

    def step(good: Column, accepted: str, following: str, why: str, without: str) -> Column:
        return F.when(good, _verdict("accept", accepted)).when(F.array_contains(available, following), _verdict("escalate", why, following)).otherwise(_verdict("quarantine_review", without))

    visual = is_("multimodal.schema_valid", "true") & is_("multimodal.uncertain_span_count", "0") & output
    return (
        F.when(outcome == "failed", _verdict("quarantine_review", "processor_failed"))
        .when(capability == "text_extract", step(is_("native.page_text_present", "true") & output, "native_text_present", "ocr", "native_text_missing_or_suspicious", "ocr_unavailable"))
        .when(capability == "ocr", step(is_("ocr.needs_visual_review", "false") & output, "ocr_accepted", "visual_transcribe", "ocr_requires_visual", "visual_escalation_unavailable"))
        .when(capability == "visual_transcribe", F.when(visual, _verdict("accept", "visual_transcription_valid")).otherwise(_verdict("quarantine_review", "visual_transcription_uncertain")))
        .when(output, _verdict("accept", "generic_output_present"))
        .otherwise(_verdict("quarantine_review", "no_accepted_policy_rule"))
    )


def escalation_ladder(targets: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Targets go through ``steps`` (capability, decision struct) as long as they are escalated: one row per target
    with the step it ended at, its decision and the steps taken. One projection: no step reads the targets again."""
    end = F.lit(None).cast("struct<step:string,decision:string,reason:string,taken:int>")
    for k, (name, d) in reversed(list(enumerate(steps, 1))):
        here = F.struct(F.lit(name).alias("step"), d["decision"].alias("decision"), d["reason"].alias("reason"), F.lit(k).alias("taken"))
        end = here if k == len(steps) else F.when((d["decision"] == "escalate") & (d["next"] == steps[k][0]), end).otherwise(here)
    return targets.withColumn("ended", end)


def scalar_verdict(expected: Column, actual: Column, kind: Column, lineage: Column, program: Column, registered: Column) -> Column:
    """Struct (outcome, verdict, code) of a scalar proposition against one query result."""
    out = lambda o, v, c: F.struct(F.lit(o).alias("outcome"), F.lit(v).cast("string").alias("verdict"), F.lit(c).cast("string").alias("code"))
    return (
        F.when(~F.coalesce(program == registered, F.lit(False)), out("failed", None, "derivation_program_mismatch"))
        .when(~F.coalesce(kind == "scalar", F.lit(False)), out("failed", None, "unsupported_consumed_result"))
        .when(~F.coalesce(lineage.isin("exact", "partial"), F.lit(False)), out("completed", "insufficient_evidence", "derivation_not_source_backed"))
        .when(actual.eqNullSafe(expected), out("completed", "supported", None))
        .otherwise(out("completed", "contradicted", None))
    )


def verdict_problems(verdicts: DataFrame, queries: DataFrame) -> DataFrame:
    """(case_id, problem) of verdicts (case_id, verdict, cited array) that their queries (query_id, case_id, ok,
    source_backed) do not carry: a decided verdict must cite, and cite own, successful, source-backed queries."""
    cited = verdicts.select("case_id", "verdict", F.explode_outer("cited").alias("query_id"))
    q = queries.select(F.col("query_id").alias("_q"), F.col("case_id").alias("_c"), "ok", "source_backed")
    met = cited.join(q, F.col("query_id") == F.col("_q"), "left")
    unknown = F.col("query_id").isNotNull() & ~F.coalesce(F.col("_c") == F.col("case_id"), F.lit(False))
    sums = met.groupBy("case_id", "verdict").agg(F.count("query_id").alias("n"), F.count_if(unknown).alias("unknown"), F.count_if(F.col("ok") & F.col("source_backed")).alias("good"))
    decided = F.col("verdict").isin("supported", "contradicted")
    problem = F.when(F.col("unknown") > 0, "unknown_query").when(decided & (F.col("n") == 0), "nothing_cited").when(decided & (F.col("good") == 0), "not_source_backed")
    return sums.select("case_id", problem.alias("problem")).where("problem is not null")


def completeness(audit: Column, possible_truncation: Column, rows: Column, resolution: Column, failure: Column, excel_rows: Column, boundaries: list[int], duplicate_of: Column) -> Column:
    """Struct (status, confidence, issue) of a published data set."""
    s = lambda a, b, c: F.struct(F.lit(a).alias("status"), F.lit(b).alias("confidence"), (c if isinstance(c, Column) else F.lit(c)).alias("issue"))
    excel = F.coalesce(excel_rows > 0, F.lit(False))
    at_limit = F.coalesce(possible_truncation, F.lit(False)) | F.coalesce(rows.isin(*boundaries), F.lit(False))
    failed = (
        F.when(failure == "recovered_api", s("complete_probable", "medium", "recovered_in_retry"))
        .when(failure == "recovered_source_file", s("source_file_only", "medium", "api_fails_source_ok"))
        .when(failure == "functional_duplicate_available", s("complete_probable", "low", F.concat(F.lit("duplicate_of_"), F.coalesce(duplicate_of, F.lit("")))))
        .when(failure == "requires_manual_download", s("requires_manual_download", "low", "endpoint_skipped"))
        .otherwise(s("api_error_persistent", "high", "http_500_persistent"))
    )
    truncated = (
        F.when(resolution == "complete_verified_by_source_file", s("complete_verified", "high", "verified_by_source_file"))
        .when(resolution == "complete_verified_by_csv_or_xlsx", s("complete_verified", "high", "verified_by_csv_or_xlsx"))
        .when(resolution == "complete_probable_exact_999_rows", s("complete_probable", "medium", "exactly_999_rows_no_more_found"))
        .when(resolution == "partial_possible_truncation_server_repeats_payload", s("partial_possible_truncation", "high", "server_repeats_payload_at_offset"))
        .when(resolution.isNotNull(), s("partial_known_limit", "medium", "at_page_boundary_unresolved"))
        .when(excel, s("complete_probable", "medium", "excel_has_data_api_may_be_partial"))
        .otherwise(s("partial_possible_truncation", "medium", "at_page_boundary_not_yet_resolved"))
    )
    return (
        F.when(audit == "metadata_only", s("metadata_only", "high", "visualization_or_no_datastream"))
        .when(audit == "datastream_failed_or_empty", failed)
        .when(at_limit, truncated)
        .when(excel | F.coalesce(rows > 0, F.lit(False)), s("complete_probable", "medium", ""))
        .otherwise(s("complete_probable", "low", "download_ok_no_row_count"))
    )


def usable(status: Column) -> Column:
    return F.when(status.isin("complete_verified", "complete_probable"), "yes").when(status.isin("partial_possible_truncation", "partial_known_limit", "source_file_only"), "only_with_caution").otherwise("no")


def truncation_resolution(api: Column, csv: Column, xlsx: Column, source: Column, repeated: Column, more: Column) -> Column:
    """Which of four row counts settles a possible truncation (null: none of that origin)."""
    best, zero = F.greatest(api, csv, xlsx, source), F.coalesce(api, F.lit(0))
    wins = lambda x: F.coalesce((x == best) & (x > zero), F.lit(False))
    return (
        F.when(wins(source), "complete_verified_by_source_file").when(wins(xlsx) | wins(csv), "complete_verified_by_csv_or_xlsx")
        .when(repeated | more, "partial_possible_truncation_server_repeats_payload").when(api == 999, "complete_probable_exact_999_rows").otherwise("partial_known_api_limit_source_unavailable")
    )


def audit_status(statuses: Column, endpoint: Column) -> Column:
    """Status of a catalogue entry from its downloads' statuses (null: no manifest)."""
    success = ("ok", "skipped_existing", "ok_redirect_followed")
    return (
        F.when(statuses.isNull(), "catalog_only").when(F.exists(statuses, lambda x: x.isin(*success)), "usable_datastream").when(endpoint.isin(*success), "endpoint_only")
        .when(F.array_contains(statuses, "possible_truncation_repeated_payload"), "possible_truncation").when(F.size(statuses) > 0, "datastream_failed_or_empty").otherwise("metadata_only")
    )


def http_outcome(status: Column) -> Column:
    return F.when(status.between(200, 299), "success").when(status.isin(404, 410), "not_found").otherwise("failed")


def abstention_scores(rows: DataFrame, expected: Column, given: Column, abstain: str = "insufficient_evidence") -> DataFrame:
    """Verdict accuracy and the precision and recall of abstentions; without any, they count as 1."""
    e, g = expected == abstain, given == abstain
    out = rows.agg(F.count("*").alias("n"), F.count_if(expected == given).alias("right"), F.count_if(e).alias("e"), F.count_if(g).alias("g"), F.count_if(e & g).alias("both"))
    share = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(empty)
    return out.select("n", share("right", "n", F.lit(None)).alias("accuracy"), share("both", "g", F.when(F.col("e") > 0, 0.0).otherwise(1.0)).alias("precision"), share("both", "e", F.lit(1.0)).alias("recall"))


def decision(empty: Column, replacement_ratio: Column, coverage: Column) -> Column:
    """accept / escalate / quarantine_review with a reason, as a struct."""
    return (
        F.when(empty, F.struct(F.lit("quarantine_review").alias("decision"), F.lit("no_text").alias("reason")))
        .when(replacement_ratio > 0.02, F.struct(F.lit("escalate").alias("decision"), F.lit("replacement_characters").alias("reason")))
        .when(coverage < 0.5, F.struct(F.lit("escalate").alias("decision"), F.lit("low_coverage").alias("reason")))
        .otherwise(F.struct(F.lit("accept").alias("decision"), F.lit("within_limits").alias("reason")))
    )


def compare_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Divergent cells of two long results (row, col, kind, value): numbers within tolerance agree."""
    a = left.select("row", "col", F.col("kind").alias("ka"), F.col("value").alias("va"))
    b = right.select("row", "col", F.col("kind").alias("kb"), F.col("value").alias("vb"))
    number = F.col("ka").isin("integer", "number") & F.col("kb").isin("integer", "number")
    same = F.when(number, close_to(F.expr("try_cast(va as double)"), F.expr("try_cast(vb as double)"))).otherwise((F.col("ka") == F.col("kb")) & F.col("va").eqNullSafe(F.col("vb")))
    return a.join(b, ["row", "col"], "full_outer").where(~F.coalesce(same, F.lit(False)))


def precision_recall(rows: DataFrame, truth: Column, predicted: Column, by: list[str]) -> DataFrame:
    """Counts and ratios of a boolean prediction; empty denominators give null."""
    out = rows.groupBy(*by).agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count("*").alias("n")
    )
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(rule, key) of all failing rows; each check is a DataFrame with a column ``key``."""
    out = None
    for rule, df in checks.items():
        part = df.select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Foreign keys without a parent; null keys are no violation."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti").select(F.col(child_key).alias("key"))


def outside_vocabulary(checks: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(vocabulary, value): distinct values that their closed vocabulary does not declare."""
    out = None
    for name, (rows, column, allowed) in checks.items():
        part = rows.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).select(F.lit(name).alias("vocabulary"), F.col(column).alias("value")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def table_fidelity(expected: DataFrame, observed: DataFrame, key: str, cells: list[str]) -> DataFrame:
    """(row_recall, cell_fidelity, false_cells) of an observed table against the expected one, by key."""
    o = observed.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in cells])
    right = sum((F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False)).cast("int") for c in cells), F.lit(0))
    met = expected.join(o, F.col(key) == F.col("_k"), "left").withColumn("_right", F.when(F.col("_k").isNotNull(), right + 1))
    width = len(cells) + 1
    out = met.agg(F.count("*").alias("n"), F.count_if(F.col("_right") == width).alias("rows"), F.sum(F.coalesce("_right", F.lit(0))).alias("cells"), F.sum(width - F.col("_right")).alias("wrong"))
    share = lambda a, b: F.when(F.col("n") > 0, F.col(a) / b).otherwise(1.0)
    return out.select(share("rows", F.col("n")).alias("row_recall"), share("cells", F.col("n") * width).alias("cell_fidelity"), F.coalesce("wrong", F.lit(0)).cast("bigint").alias("false_cells"))


def errors(**checks: Column) -> Column:
    """Names of the checks that hold, as a sorted array: a row's list of errors."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in sorted(checks.items())]))
