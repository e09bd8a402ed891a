"""Guarded read-only SQL: one SELECT over named tables, with an allow-list of functions and hard budgets.

The statement is parsed (not run) by Spark's own parser; the unresolved plan is checked before analysis, so
nothing that is refused ever touches data. Results are typed cells with a canonical JSON form and digest.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import threading
import uuid
from dataclasses import asdict, dataclass, field
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

#: The functions the surface allows.
FUNCTIONS = frozenset(
    "abs avg coalesce count dense_rank first_value ifnull lag last_value lead length lower max min nth_value nullif printf rank replace round row_number substr substring sum total upper".split()
)
#: Limits of the default policy.
MAX_ROWS, MAX_BYTES, MAX_INPUT_BYTES, TIMEOUT_MS = 1_000, 1_000_000, 16_000_000, 2_000

FORMAT = "lodestone.query_result.v1"


class GuardError(Exception):
    """A refused or failed query; ``code`` is stable."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Policy:
    max_rows: int = MAX_ROWS
    max_bytes: int = MAX_BYTES
    max_input_bytes: int = MAX_INPUT_BYTES
    timeout_ms: int = TIMEOUT_MS
    max_product_bytes: int = 10_000_000_000
    functions: frozenset[str] = field(default=FUNCTIONS)

    def digest(self) -> str:
        """Identity of the configuration: SHA-256 of its canonical JSON."""
        return sha256_json({k: sorted(v) if isinstance(v, frozenset) else v for k, v in asdict(self).items()})


@dataclass(frozen=True)
class Result:
    columns: list[str]
    rows: list[list[dict | None]]
    kind: str  # scalar or table
    lineage: str  # partial or none
    tables: list[str]

    def document(self) -> dict:
        return {"format": FORMAT, "columns": self.columns, "rows": self.rows, "row_count": len(self.rows), "truncated": False}

    def digest(self) -> str:
        return sha256_json(self.document())


def canonical_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def sha256_json(value) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def cell(value) -> dict | None:
    """Canonical typed cell: integers and numbers as text, bytes as hex; non-finite numbers are refused."""
    if value is None:
        return None
    if isinstance(value, bool):
        return {"type": "boolean", "value": value}
    if isinstance(value, int):
        return {"type": "integer", "value": str(value)}
    if isinstance(value, (float, Decimal)):
        if not math.isfinite(value):
            raise GuardError("query_result_invalid", "a number is not finite")
        return {"type": "number", "value": repr(float(value)) if isinstance(value, float) else format(value, "f")}
    if isinstance(value, (bytes, bytearray)):
        return {"type": "bytes", "value": bytes(value).hex()}
    if isinstance(value, (datetime, date)):
        return {"type": "string", "value": value.isoformat()}
    if isinstance(value, str):
        return {"type": "string", "value": value}
    raise GuardError("query_result_invalid", type(value).__name__)


#: Plan and expression nodes of a permitted statement, as Spark's parser names them; every other node is refused,
#: whatever syntax it came from.
NODES = frozenset(
    "Project Filter GlobalLimit LocalLimit Offset Sort UnresolvedHaving Aggregate WithWindowDefinition UnresolvedWith UnresolvedSubqueryColumnAliases OneRowRelation Join SubqueryAlias "
    "UnresolvedRelation Except Distinct Union Intersect UnresolvedAlias Alias Cast UnresolvedAttribute CaseWhen Literal EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan "
    "LessThanOrEqual Concat UnaryPositive UnaryMinus Add Subtract Multiply Divide Remainder Or And Not IsNull IsNotNull In InSubquery ListQuery Exists ScalarSubquery UnresolvedStar "
    "UnresolvedFunction SortOrder UnresolvedOrdinal WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ UnboundedFollowing$ UnboundedPreceding$ "
    "UnresolvedWindowExpression CurrentRow$ BitwiseAnd BitwiseOr BitwiseNot".split()
)
#: Names that the analyser reads as functions or hidden columns where no column has them.
HIDDEN = frozenset("current_user user session_user current_date current_time current_timestamp localtimestamp current_catalog current_database current_schema grouping__id _metadata".split())
_COMMAND = re.compile(r"Command|Insert|Create|Drop|Alter|Delete|Update|Merge|Truncate|SetCatalog|UseNamespace|Cache|Explain|Describe|Show|Replace(Table|Data)|Script|LocalRelation$")


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _walk(plan, scope: frozenset[str] = frozenset()):
    """All nodes of a parsed plan with the names of the common table expressions they can see: subqueries and
    definitions included, a definition sees only those before it."""
    stack = [(plan, scope)]
    while stack:
        node, seen = stack.pop()
        yield node, seen
        name = node.getClass().getSimpleName()
        if name == "UnresolvedWith":
            for d in _seq(node.cteRelations()):
                stack.append((d._2(), seen))
                seen = seen | {d._1().lower()}
        stack.extend((x, seen) for x in _seq(node.children()))
        if hasattr(node, "expressions"):
            try:
                exprs = _seq(node.expressions())
            except Exception:  # expressions have no expressions of their own
                exprs = []
            stack.extend((x, seen) for x in exprs)
        if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            stack.append((node.plan(), seen))


def inspect(spark: SparkSession, sql: str, tables: set[str], functions: frozenset[str] = FUNCTIONS) -> list[str]:
    """The source tables a permitted statement reads; GuardError otherwise."""
    text = sql.strip()
    if not text.strip(";").strip():
        raise GuardError("query_empty")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text.rstrip().rstrip(";"))
    except Exception as e:
        code = "query_multiple_statements" if ";" in text.rstrip(";") and re.search(r";\s*\S", text) else "query_invalid"
        raise GuardError(code, str(e).splitlines()[0][:200]) from None
    allowed, sources = {x.lower() for x in tables}, set()
    for node, seen in _walk(plan):
        name = node.getClass().getSimpleName()
        if name not in NODES:
            raise GuardError("query_not_select" if node.equals(plan) and _COMMAND.search(name) else "query_forbidden_operation", name)
        if name == "UnresolvedWith" and node.allowRecursion():
            raise GuardError("query_forbidden_operation", "recursion")
        if name == "UnresolvedRelation":
            table = ".".join(_seq(node.multipartIdentifier())).lower()
            if table not in seen:
                sources.add(table)
        elif name == "UnresolvedAttribute":
            if not HIDDEN.isdisjoint(x.lower() for x in _seq(node.nameParts())):
                raise GuardError("query_forbidden_operation", ".".join(_seq(node.nameParts())))
        elif name == "UnresolvedFunction":
            f = ".".join(_seq(node.nameParts())).lower()
            if f not in functions:
                raise GuardError("query_forbidden_operation", f)
    for table in sorted(sources - allowed):
        raise GuardError("query_forbidden_operation", table)
    return sorted(sources)


def relations(plan) -> set[str]:
    """What an analysed plan reads: views by name, any other source by the class of its node."""
    out, stack = set(), [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        children = _seq(node.children())
        if name == "View":
            out.add(node.desc().identifier().table().lower())
            continue
        if not children and name not in ("OneRowRelation", "CTERelationRef", "LocalRelation"):
            out.add(f"<{name}>")
        stack.extend(children)
        stack.extend(x for x in _seq(node.innerChildren()) if hasattr(x, "children") and hasattr(x, "output"))
        for e in _seq(node.expressions()):
            inner = [e]
            while inner:
                x = inner.pop()
                if x.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                    stack.append(x.plan())
                inner.extend(_seq(x.children()))
    return out


_TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z_0-9.]*|\s+|.""", re.S)


def _null_if_any(args: list[str], best: str) -> str:
    """max(a, b) and min(a, b): null if any argument is."""
    return "CASE WHEN " + " OR ".join(f"({a}) IS NULL" for a in args) + f" THEN NULL ELSE {best}({', '.join(args)}) END"


def _substr(args: list[str]) -> str:
    """Place 0 stands before the first character; a negative length takes what stands before the place."""
    x, y = args[0], f"({args[1]})"
    if len(args) == 2:
        return f"substring({x}, CASE WHEN {y} = 0 THEN 1 ELSE {y} END)"
    z = f"({args[2]})"
    before = f"substring({x}, greatest({y} + {z}, 1), least(-{z}, greatest({y} - 1, 0)))"
    return f"CASE WHEN {z} < 0 AND {y} > 0 THEN {before} WHEN {y} = 0 THEN substring({x}, 1, {z} - 1) ELSE substring({x}, {y}, {z}) END"


def rewrite(sql: str) -> str:
    """The embedded database's functions in Spark's terms: total(x), with or without OVER, as a double that is 0 for
    no rows; max and min of several arguments; substr."""
    tokens = _TOKEN.findall(sql)

    def skip(i: int) -> int:
        while i < len(tokens) and (tokens[i].isspace() or tokens[i].startswith(("--", "/*"))):
            i += 1
        return i

    def closing(i: int) -> int:
        depth = 0
        for k in range(i, len(tokens)):
            depth += (tokens[k] == "(") - (tokens[k] == ")")
            if depth == 0:
                return k
        return len(tokens) - 1

    def arguments(i: int, end: int) -> list[str]:
        out, depth, at = [], 0, i
        for k in range(i, end):
            depth += (tokens[k] == "(") - (tokens[k] == ")")
            if tokens[k] == "," and depth == 0:
                out.append("".join(tokens[at:k]))
                at = k + 1
        return [rewrite(x).strip() for x in (*out, "".join(tokens[at:end]))]

    out, i = [], 0
    while i < len(tokens):
        name, at = tokens[i].lower(), skip(i + 1)
        if name in ("total", "max", "min", "substr", "substring") and at < len(tokens) and tokens[at] == "(":
            end = closing(at)
            args, after = arguments(at + 1, end), end + 1
            if name == "total":
                over, k = "", skip(end + 1)
                if k < len(tokens) and tokens[k].lower() == "over":
                    w = skip(k + 1)
                    stop = closing(w) if w < len(tokens) and tokens[w] == "(" else w
                    over, after = " " + "".join(tokens[k : stop + 1]), stop + 1
                out.append(f"coalesce(sum(cast({args[0]} as double)){over}, 0D)")
            elif name in ("max", "min"):
                out.append(_null_if_any(args, "greatest" if name == "max" else "least") if len(args) > 1 else f"{tokens[i]}({args[0]})")
            else:
                out.append(_substr(args) if len(args) in (2, 3) else "".join(tokens[i : end + 1]))
            i = after
        else:
            out.append(tokens[i])
            i += 1
    return "".join(out)


#: Functions that ``rewrite`` puts into a statement.
MADE = frozenset({"greatest", "least", "sum", "coalesce", "substring"})


class GuardedSession:
    """Runs guarded SELECTs over the given tables in an isolated session; a batch shares the tables."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], policy: Policy | None = None):
        self.policy = policy or Policy()
        self.tables = {k.lower(): v for k, v in tables.items()}
        self.spark = spark.newSession()
        for name, df in self.tables.items():  # the same analysed plan under a private catalog
            DataFrame(_rebind(self.spark, df), self.spark).createOrReplaceTempView(name)

    def query(self, sql: str, policy_digest: str | None = None) -> Result:
        if policy_digest is not None and policy_digest != self.policy.digest():
            raise GuardError("configuration_mismatch")
        text = rewrite(sql.strip().rstrip(";"))
        read = inspect(self.spark, sql, set(self.tables), self.policy.functions)
        # what runs is the rewritten text: it is held to the same rules, and must read what the statement reads
        if inspect(self.spark, text, set(self.tables), self.policy.functions | MADE) != read:
            raise GuardError("query_forbidden_operation", "comments or quotes that read differently")
        size = sum(self._bytes(self.tables[t]) for t in read)
        if size > self.policy.max_input_bytes:
            raise GuardError("query_input_too_large", f"{size} bytes")
        try:
            df = self.spark.sql(text)
        except Exception as e:
            raise GuardError("query_invalid", str(e).splitlines()[0][:200]) from None
        if relations(df._jdf.queryExecution().analyzed()) != set(read):
            raise GuardError("query_forbidden_operation", "a relation outside the list")
        self._admit(df)
        rows = self._bounded(df)
        cells = [[cell(v) for v in r] for r in rows]
        kind = "scalar" if len(rows) == 1 and len(df.columns) == 1 else "table"
        out = Result(df.columns, cells, kind, "partial" if read else "none", read)
        if len(canonical_json(out.document())) > self.policy.max_bytes:
            raise GuardError("query_result_too_large")
        return out

    def _bytes(self, df: DataFrame) -> int:
        """Size of an input as planned; where that is unknown, by its rows (counted up to the limit) and columns."""
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if size < 1 << 62:
            return size
        width = 8 + sum(8 if f.dataType.simpleString() not in ("string", "binary") else 20 for f in df.schema)
        return width * df.limit(min(self.policy.max_input_bytes // width + 1, (1 << 31) - 1)).count()

    def _admit(self, df: DataFrame) -> None:
        """Refuse products of relations before they run: a nested loop cannot be interrupted midway."""
        plan = df._jdf.queryExecution()
        if re.search("CartesianProduct|BroadcastNestedLoopJoin", plan.executedPlan().toString()):
            for node, _ in _walk(plan.optimizedPlan()):
                if node.getClass().getSimpleName() == "Join" and int(node.stats().sizeInBytes()) > self.policy.max_product_bytes:
                    raise GuardError("query_budget_exceeded", "product of relations")

    def _bounded(self, df: DataFrame) -> list:
        """At most max_rows rows within the time limit; more is an error, never a truncation."""
        sc, tag, late = self.spark.sparkContext, f"guard-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(self.policy.timeout_ms / 1000, stop)
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)
        timer.start()
        try:
            rows = df.limit(self.policy.max_rows + 1).collect()
        except Exception as e:
            raise GuardError("query_budget_exceeded" if late.is_set() else "query_invalid", str(e).splitlines()[0][:200]) from None
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
        if len(rows) > self.policy.max_rows:
            raise GuardError("query_result_too_large")
        return rows

    def run_batch(self, statements: list[str]) -> list[Result | GuardError]:
        if len(statements) > 128:
            raise GuardError("query_budget_exceeded", "at most 128 statements")
        out: list[Result | GuardError] = []
        for s in statements:
            try:
                out.append(self.query(s))
            except GuardError as e:
                out.append(e)
        return out


def _rebind(session: SparkSession, df: DataFrame):
    """The plan of ``df`` as a Java DataFrame of another session of the same application."""
    jvm = session._jvm
    return getattr(getattr(jvm.org.apache.spark.sql.classic, "Dataset$"), "MODULE$").ofRows(session._jsparkSession, df._jdf.queryExecution().logical())
