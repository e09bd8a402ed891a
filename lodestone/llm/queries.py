"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language, mixing, near_dedup, phrase_dedup, pii, quality, snapshot_diff, substring_dedup, url_filter, vector_codes, vp_search
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), size=200)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return snapshot_diff.snapshot_diff(docs, snapshot_diff.later_snapshot(docs))


def op12_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_dedup.remove_phrases(table(spark, sf_dir, "documents"), words=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_html_text": op8_html_text,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_url_filter": op10_url_filter,
    "op11_snapshot_diff": op11_snapshot_diff,
    "op12_phrase_dedup": op12_phrase_dedup,
    "op13_vector_codes": op13_vector_codes,
}

#: Nearest neighbours by brute force. The registered query prunes with a factor above 1, but finds all on
#: the test tables; its recall is measured in the tests.
_OP2 = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of items and documents as joined words; a hit word lies in some window that an item has.
_OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wb AS (SELECT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM wb),
wd AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT r, i, wd.k, item FROM wd JOIN wb ON wd.win = wb.win AND wd.k = wb.k),
hw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""

#: All pairs that share a shingle, exact similarities, and the closure of the links.
_OP9 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS sh FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.r <> y.r GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
reach(r, m) AS (SELECT r, doc_id FROM d UNION SELECT e.b, reach.m FROM reach JOIN e ON e.a = reach.r),
c AS (SELECT r, min(m) AS m FROM reach GROUP BY r)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, doc_id = c.m AS kept FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""

#: crc32 bit by bit; pairs by key, then by content and rank within it.
_OP11 = """
WITH c AS (
  SELECT doc_id, text, lang, source,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 10 AS m
  FROM documents
), later AS (
  SELECT unnest(CASE WHEN m = 0 THEN [] WHEN m IN (3, 4) THEN [-1 - doc_id] WHEN m = 5 THEN [doc_id, -1 - doc_id] ELSE [doc_id] END) AS k,
    CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN m = 2 THEN source ELSE lang END AS lang,
    CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source
  FROM c
), j AS (
  SELECT e.doc_id AS ek, e.text AS et, e.lang AS el, e.source AS es, e.doc_id IS NOT NULL AS eh, l.k AS lk, l.text AS lt, l.lang AS ll, l.source AS ls, l.k IS NOT NULL AS lh
  FROM documents e FULL OUTER JOIN later l ON e.doc_id = l.k
), e AS (SELECT ek, et, el, es, row_number() OVER (PARTITION BY et, el, es ORDER BY ek) AS i FROM j WHERE NOT lh),
l AS (SELECT lk, lt, ll, ls, row_number() OVER (PARTITION BY lt, ll, ls ORDER BY lk DESC) AS i FROM j WHERE NOT eh),
r AS (
  SELECT ek, lk, lt, ll, ls, e.i IS NULL AS ins, l.i IS NULL AS del FROM e FULL OUTER JOIN l
  ON et IS NOT DISTINCT FROM lt AND el IS NOT DISTINCT FROM ll AND es IS NOT DISTINCT FROM ls AND e.i = l.i
), a AS (
  SELECT lk AS key, ek AS old_key, concat_ws(',', CASE WHEN et IS DISTINCT FROM lt THEN 'text' END, CASE WHEN el IS DISTINCT FROM ll THEN 'lang' END,
    CASE WHEN es IS DISTINCT FROM ls THEN 'source' END) AS changed, lt, ll, ls, NULL AS op FROM j WHERE eh AND lh
  UNION ALL SELECT coalesce(lk, ek), ek, '', lt, ll, ls, CASE WHEN ins THEN 'insert' WHEN del THEN 'delete' ELSE 'rekey' END FROM r
)
SELECT key, old_key, coalesce(op, CASE WHEN changed = '' THEN 'same' ELSE 'update' END) AS op, changed,
  CASE WHEN op = 'delete' THEN NULL ELSE sha256(coalesce(lt, '~') || chr(10) || coalesce(ll, '~') || chr(10) || coalesce(ls, '~')) END AS row_sha256
FROM a
"""


#: Every window of 13 words with the smallest doc_id that has it.
_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS low FROM x GROUP BY win),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (win) WHERE low < coalesce(doc_id, 9223372036854775807))),
k AS (SELECT r, count(*) AS n, string_agg(o, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS o, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""


def _op13(rounds: int = 6) -> str:
    """Lloyd rounds written out one after another, over all vectors."""
    nearest = "SELECT r, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT q.r, q.p, q.x, b.e, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - b.y[i]) * (q.x[i] - b.y[i])))::BIGINT AS d FROM q JOIN b{0} b USING (p)) GROUP BY r, p, x"
    floored = "((sum(x[i])::HUGEINT - ((sum(x[i])::HUGEINT % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS ({nearest.format(k)})")
        steps.append(
            f"m{k} AS (SELECT p, e, list(v ORDER BY i) AS y FROM (SELECT p, e, i, {floored} AS v FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM q))) AS i) GROUP BY p, e, i) GROUP BY p, e)"
        )
        steps.append(f"b{k + 1} AS (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN m{k} m USING (p, e))")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT r, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM k, (SELECT unnest(range(8)) AS p)),
b0 AS (SELECT p, r - 1 AS e, x AS y FROM q WHERE r <= 16),
{", ".join(steps)},
f AS ({nearest.format(rounds)}),
g AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: c::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN g USING (r), h
"""


ORACLE_SQL: dict[str, str] = {"op2_nearest_neighbours": _OP2, "op4_decontamination": _OP4, "op9_near_duplicates": _OP9, "op11_snapshot_diff": _OP11, "op12_phrase_dedup": _OP12, "op13_vector_codes": _op13()}
