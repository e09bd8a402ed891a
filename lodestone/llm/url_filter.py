"""URL filters: host and path rules, then a path-template tree for what no rule decides.

Rules are (verdict, "host/path"): a rule fits its host and all subdomains where the url's path starts with
the rule's path; the longest fitting rule wins. Urls that a rule decides are the labelled ones.

The tree has one branch per host and path prefix, as deep as the paths go. Each path segment is first generalised: segments that
vary (numbers, hexadecimal or long mixed identifiers, page names with an extension) become typed
wildcards. Sibling branches under one parent whose labelled block rates do not differ significantly
(z-test against the rate of all siblings) merge into ``*``; a branch without labels joins them only where
the position is variable, with at least ``variable`` values, and otherwise keeps its name. Above the hosts
stands one more tree, of the same paths under the host ``*``, merged by the same test over the labels of all
hosts (there a branch without labels always keeps its name). A host's template scores the share of blocked among its labelled urls, smoothed by ``prior`` urls at
the rate of the template of the same path above the hosts; that one is smoothed by ``prior`` urls at ``base``.
Templates with a score of at least ``threshold`` are rejected, so nothing is without labelled evidence: a host
without labels is judged by what paths of its shape are elsewhere.

Everything is one map over urls and aggregations of (host, template) counts: map-side combined, so a hot
host costs its distinct templates, not its urls.

* A null url, or one without "://": host and path are empty, no rule fits and, without labels, the verdict is allow.
* Repeated rows are judged alike; empty tables give empty results; extra columns are ignored.
* Very long urls are read whole, at any depth: the tree takes as many rounds as one path has forks.
* Ties between rules of one length cannot fit one url unless equal; the first listed wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_side, stage

#: Fixed values of the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: More values than any position has.
NEVER = 1 << 62
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule's text, or null."""
    out = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    for _, text in reversed(ordered):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def segment_kind(segment: Column) -> Column:
    """A variable segment's wildcard, else the segment itself."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
        .when(segment.rlike(r"^[^.]*[0-9][^.]*\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.lower(F.regexp_extract(segment, r"\.([A-Za-z0-9]{1,5})$", 1))))
        .when(segment.rlike(r"[0-9]") & (F.length(segment) >= 12), F.lit("{id}"))
        .otherwise(segment)
    )


def _shared(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def tree(counts: DataFrame, z: float = 3.0, variable: int = 8) -> DataFrame:
    """(host, segments, template, n, b): the merged tree with the labelled and the blocked urls of each template,
    one row for each branch before merging. ``counts`` has host, segments (generalised, all of them), n and b.

    A round takes every template to its next fork and decides its branches there. On the way to the fork there is one
    branch a level, which is kept where it has no labels and merged where it has, so these levels need no round:
    what lies before the fork is the common prefix of the template's least and greatest rest of path. There are as
    many rounds as forks on one path, however deep the paths go, and a path that shares no fork any more ends."""
    rows, ended, k = stage(counts.withColumn("template", F.col("host")).withColumn("k", F.lit(0)), "url-templates"), [], 0
    while True:
        rest = F.slice("segments", F.col("k") + 1, F.greatest(F.size("segments") - F.col("k"), F.lit(0)))
        group = rows.groupBy("template").agg(F.min(rest).alias("least"), F.max(rest).alias("most"), F.sum("n").alias("all_n"), F.count("*").alias("rows"))
        labels = F.col("all_n") > 0
        trunk = F.array_join(F.transform(F.slice("least", F.lit(1), F.col("shared")), lambda x: F.concat(F.lit("/"), F.when(labels, "*").otherwise(x))), "")
        group = group.withColumn("shared", _shared(F.col("least"), F.col("most"))).select("template", "shared", trunk.alias("trunk"), (F.col("rows") == 1).alias("alone"))
        moved = rows.join(small_side(stage(group, f"url-group{k}")), "template")
        moved = moved.select("host", "segments", "n", "b", F.concat("template", "trunk").alias("template"), (F.col("k") + F.col("shared")).alias("k"), "alone")
        ended.append(moved.where("alone").select("host", "segments", "n", "b", "template"))
        # a path that has ended takes part once more, as the branch ""
        level = stage(moved.where("not alone").drop("alone").withColumn("at", F.coalesce(F.get("segments", F.col("k")), F.lit(""))), f"url-level{k}")
        if level.isEmpty():
            break
        branch = level.groupBy("template", "at").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        around = branch.groupBy("template").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.count("*").alias("width"))
        rate = F.try_divide("all_b", "all_n")
        apart = F.abs(F.try_divide("b", "n") - rate) > z * F.sqrt(F.try_divide(rate * (1 - rate), "n"))
        unknown = (F.col("n") == 0) & (F.col("width") < variable)
        keep = unknown | F.coalesce(apart, F.lit(False))
        name = F.when(F.col("at") == "", "").otherwise(F.concat(F.lit("/"), F.when(keep, F.col("at")).otherwise("*")))
        named = branch.join(small_side(stage(around, f"url-around{k}")), "template").select("template", "at", name.alias("name"))
        rows = level.join(named, ["template", "at"]).select("host", "segments", "n", "b", F.concat("template", "name").alias("template"), (F.col("k") + 1).alias("k"), (F.col("at") == "").alias("done"))
        rows = stage(rows, f"url-{k + 1}")
        ended.append(rows.where("done").select("host", "segments", "n", "b", "template"))
        rows, k = rows.where("not done").drop("done"), k + 1
        if rows.isEmpty():
            break
    merged = reduce(DataFrame.unionByName, ended)
    sums = merged.groupBy("template").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    return merged.drop("n", "b").join(small_side(stage(sums, "url-sums")), "template")


def templates(urls: DataFrame, prior: float = 2.0, base: float = 0.2, z: float = 3.0, variable: int = 8) -> DataFrame:
    """(host, segments, template, score): each branch's template and its smoothed block purity."""
    counts = stage(urls.groupBy("host", "segments").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("b")), "url-counts")
    above = counts.groupBy("segments").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).withColumn("host", F.lit("*"))
    shape = tree(above, z, NEVER).select("segments", ((F.col("b") + prior * base) / (F.col("n") + prior)).alias("shape"))
    own = tree(counts, z, variable).join(small_side(stage(shape, "url-shapes")), "segments")
    return own.select("host", "segments", "template", ((F.col("b") + prior * F.col("shape")) / (F.col("n") + prior)).alias("score"))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, template, score), one for each row of ``pages``.
    ``verdict`` is the rule's where one fits, else block where the template's score reaches ``threshold``."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = {text: verdict for verdict, text in reversed(rules)}
    given = F.lit(None).cast("string")
    for text, verdict in verdicts.items():
        given = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(given)
    segments = F.filter(F.split(F.regexp_replace("path", r"^/+|/+$", ""), "/+"), lambda x: x != "")
    urls = urls.withColumns({"given": given, "label": (given == "block").cast("int"), "segments": F.transform(segments, segment_kind)})
    with scratch():
        scored = stage(templates(urls), "url-scores", keep=True)
    out = urls.join(small_side(scored), ["host", "segments"])
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "template", "score")
