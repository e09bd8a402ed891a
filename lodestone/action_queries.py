"""Registered queries over review actions and snapshots, on the shop's tables.

A sale's versions are an action sent once and again: the first that arrived is what is known (of sales before March;
what came over three hours late was noted as open), the last is the request; its lines are the
decisions, of which those shipped by then are known. Client changes give the state a reviewer saw and the present one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import actions, review
from .queries import C, query

_ORDER = ("arrived_at", "client_id", "status", "total")
_ACTIONS = f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY {', '.join(c + ' NULLS FIRST' for c in _ORDER)}) AS up, row_number() OVER (PARTITION BY sale_id ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in _ORDER)}) AS down FROM sales WHERE sale_id IS NOT NULL),
k AS (SELECT sale_id, client_id, CASE WHEN arrived_at > sold_at + INTERVAL 3 HOUR THEN 'open' ELSE status END AS status, total FROM s WHERE up = 1 AND sold_at < TIMESTAMP '2024-03-01'), r AS (SELECT sale_id, client_id, status, total, CASE WHEN status <> 'open' THEN priority END AS rep FROM s WHERE down = 1),
d AS (SELECT sale_id, item_id, flag, quantity FROM sale_lines WHERE sale_id IN (SELECT sale_id FROM r)), o AS (SELECT sale_id, item_id, flag, quantity FROM sale_lines WHERE shipped_at < DATE '2024-03-05' AND sale_id IN (SELECT sale_id FROM k)),
differ AS (SELECT DISTINCT sale_id FROM ((SELECT * FROM d WHERE sale_id IN (SELECT sale_id FROM k) EXCEPT ALL SELECT * FROM o) UNION ALL (SELECT * FROM o EXCEPT ALL SELECT * FROM d))),
live AS (SELECT item_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM items n WHERE n.size = 1 AND n.item_id - 1 = i.item_id)), e AS (SELECT DISTINCT item_id, vendor_id % 5 + 1 AS rep FROM sale_lines WHERE flag = 'kept' AND item_id IS NOT NULL),
f AS (SELECT r.sale_id, CASE WHEN k.sale_id IS NOT NULL AND (k.client_id IS DISTINCT FROM r.client_id OR k.status IS DISTINCT FROM r.status OR k.total IS DISTINCT FROM r.total) THEN 'action_collision' WHEN k.sale_id IS NOT NULL AND r.sale_id IN (SELECT sale_id FROM differ) THEN 'decision_collision' WHEN k.sale_id IS NOT NULL THEN 'replayed'
WHEN EXISTS (SELECT 1 FROM d WHERE d.sale_id = r.sale_id AND (d.item_id IS NULL OR d.item_id NOT IN (SELECT item_id FROM live WHERE item_id IS NOT NULL))) THEN 'subject_not_current' WHEN r.rep IS NOT NULL AND EXISTS (SELECT 1 FROM d LEFT JOIN e ON e.item_id = d.item_id AND e.rep = r.rep WHERE d.sale_id = r.sale_id AND e.item_id IS NULL) THEN 'no_evidence' ELSE 'recorded' END AS state
FROM r LEFT JOIN k ON k.sale_id = r.sale_id)"""


def _answers(t):
    sales = t("sales").where("sale_id is not null").select("sale_id", *_ORDER, "sold_at", "priority")
    order = [C(c) for c in _ORDER]
    pick = lambda best: sales.groupBy(C("sale_id").alias("action")).agg(best(F.struct("client_id", "status", "total", "sold_at", "arrived_at", "priority"), F.struct(*order)).alias("v")).select("action", "v.*")
    named = lambda df, *more: df.select("action", C("client_id").alias("actor"), C("status").alias("mode"), C("total").alias("note"), *more)
    late = F.when(C("arrived_at") > C("sold_at") + F.expr("interval 3 hours"), "open").otherwise(C("status"))
    known = named(pick(F.min_by).where("sold_at < timestamp '2024-03-01'").withColumn("status", late))
    requests = named(pick(F.max_by), F.when(C("status") != "open", C("priority")).alias("representation"))
    lines = t("sale_lines")
    decisions = lines.select(C("sale_id").alias("action"), C("item_id").alias("subject"), C("flag").alias("decision"), C("quantity").alias("reason"), "shipped_at")
    revisions = t("items").select(C("item_id").alias("subject"), F.when(C("size") == 1, C("item_id") - 1).alias("supersedes"))
    evidence = lines.where("flag = 'kept' and item_id is not null").select(C("item_id").alias("subject"), (C("vendor_id") % 5 + 1).alias("representation"))
    return actions.answered(requests, decisions, known, decisions.where("shipped_at < date '2024-03-05'"), revisions, evidence), decisions


@query(_ACTIONS + " SELECT f.sale_id, state, (SELECT count(*) FROM d WHERE d.sale_id = f.sale_id) AS decisions FROM f")
def review_answers(t):
    return _answers(t)[0].withColumnRenamed("action", "sale_id")


@query(_ACTIONS + " SELECT d.sale_id, item_id, flag, quantity FROM d JOIN f ON f.sale_id = d.sale_id WHERE state = 'recorded'")
def review_appended(t):
    answers, decisions = _answers(t)
    return actions.appended(answers, decisions).select(C("action").alias("sale_id"), C("subject").alias("item_id"), C("decision").alias("flag"), C("reason").alias("quantity"))


_CHANGES = ("valid_at", "seq", "change_id", "op", "source", "segment", "city", "balance")


@query(f"""WITH now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in _CHANGES)}) AS rn FROM client_changes WHERE client_id IS NOT NULL) WHERE rn = 1),
seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in _CHANGES)}) AS rn FROM client_changes WHERE client_id IS NOT NULL AND valid_at < DATE '2024-03-01') WHERE rn = 1)
SELECT s.client_id, CASE WHEN n.op <> 'D' THEN sha256(to_json({{'source': n.source, 'segment': n.segment, 'city': n.city}})) END AS sha256,
n.op = 'D' OR s.source IS DISTINCT FROM n.source OR s.segment IS DISTINCT FROM n.segment OR s.city IS DISTINCT FROM n.city AS stale FROM seen s JOIN now n ON n.client_id = s.client_id WHERE s.op <> 'D'""")
def snapshot_drift(t):
    changes, order = t("client_changes").where("client_id is not null"), [C(c) for c in _CHANGES]
    seen = actions.state_as_of(changes, "client_id", order, C("valid_at") < F.lit("2024-03-01").cast("date"))
    now = actions.state_as_of(changes, "client_id", order)
    return actions.drifted(seen.where("op <> 'D'"), now.where("op <> 'D'"), "client_id", review.snapshot_hash(F.struct("source", "segment", "city")))
