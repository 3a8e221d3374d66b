"""SQL under an access policy, enforced on the analysed plan.

A query is parsed, never run, before it is checked. It is analysed in a session of its own that holds only the relations the
buyer has live grants on, so a name without a grant, in whatever part of the query, isn't there. A relation whose rows belong
to assets is semi-joined with the live grants; any other needs a grant under its own name.

A policy with a least group size reads the plan's tree from the root. Each path must reach an aggregate before a relation;
that top aggregate keeps only groups that rest on enough distinct records of every relation below it. Records are told apart
by the relation's key, carried up through projections and joins; an aggregate further down passes on the least record of each
of its groups, which can only make the count lower. So neither joins with literals or with itself, nor exploded arrays, nor
aggregates in a sub-query, nor a union with one aggregated branch make a small group look large. What can't be followed
(sub-query expressions above the aggregate; DISTINCT, set operations, windows, grouping sets or samples below it) is
refused. Queries that differ by a few records can still be compared: that is for noise (``governance.laplace``) to prevent.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .governance import POLICIES, AccessDenied, Policy, first_rows

RECORD = "_record"
_PLANS = "org.apache.spark.sql.catalyst.plans.logical"
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions"
#: Statements by the plan node they parse to; what isn't here and isn't a query is never allowed.
WRITES = {"InsertIntoStatement": "INSERT", "UpdateTable": "UPDATE", "DeleteFromTable": "DELETE", "MergeIntoTable": "MERGE"}
#: Nodes that pass on the rows of their children, above a top aggregate and below it.
_ABOVE = frozenset("Project Filter Sort GlobalLimit LocalLimit Offset Tail SubqueryAlias Distinct Deduplicate Window Union Join ResolvedHint Generate".split())
_LITERALS = frozenset("OneRowRelation LocalRelation Range".split())
_THROUGH = frozenset("Filter SubqueryAlias Generate ResolvedHint".split())


@dataclass(frozen=True)
class Relation:
    """A table offered for governed SQL: the columns that tell its records apart, and the one that names a row's asset."""

    rows: DataFrame
    key: tuple[str, ...]
    asset: str | None = None


def _each(seq: JavaObject) -> list[JavaObject]:
    return [seq.apply(k) for k in range(seq.size())]


def _parts(node: JavaObject) -> list[JavaObject]:
    """A plan's nodes, those of the sub-queries in its expressions among them."""
    return [node] + [x for part in (*_each(node.children()), *_each(node.subqueries())) for x in _parts(part)]


def statement(spark: SparkSession, query: str) -> str:
    """SELECT for a query, the kind of write for one of ``WRITES``, else OTHER; nothing is run."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except ParseException as e:
        raise AccessDenied("not a statement") from e
    kinds = {WRITES.get(n.nodeName(), "OTHER") for n in _parts(plan) if is_instance_of(spark._sc._gateway, n, f"{_PLANS}.Command") or is_instance_of(spark._sc._gateway, n, f"{_PLANS}.ParsedStatement")}
    return "SELECT" if not kinds else kinds.pop() if len(kinds) == 1 else "OTHER"


def check_operation(spark: SparkSession, query: str, policy: str) -> str:
    """The statement's kind, if the policy allows it."""
    kind, rules = statement(spark, query), POLICIES.get(policy, POLICIES["read_only"])
    if kind not in rules.operations:
        raise AccessDenied(f"{kind} is not allowed")
    return kind


def live_grants(grants: DataFrame, buyer: int, as_of: str) -> DataFrame:
    """The assets (column ``asset``) that a buyer holds an active grant on at a time."""
    t = F.lit(as_of).cast("timestamp_ntz")
    live = (F.col("buyer") == buyer) & (F.col("status") == "active") & (F.col("valid_from") <= t) & (F.col("valid_until") >= t)
    return grants.where(live).select(F.col("asset").cast("string").alias("asset")).distinct()


def governed_session(spark: SparkSession, relations: dict[str, Relation], grants: DataFrame | None, buyer: int | None, as_of: str | None) -> SparkSession:
    """A session whose only relations are the granted ones, each with an opaque ``_record`` column."""
    out = spark.newSession()
    out.conf.set("spark.sql.runSQLOnFiles", "false")
    live = None if grants is None else live_grants(grants, buyer, as_of)
    named = None if live is None else {r["asset"] for r in live.where(F.col("asset").isin(list(relations))).collect()}
    for name, relation in relations.items():
        rows = relation.rows.withColumn(RECORD, F.xxhash64(*relation.key))
        if live is not None and relation.asset:
            rows = rows.join(live, rows[relation.asset].cast("string") == live["asset"], "left_semi")
        elif named is not None and name not in named:
            continue
        jdf = out._jvm.org.apache.spark.sql.classic.Dataset.ofRows(out._jsparkSession, rows._jdf.queryExecution().analyzed())
        jdf.createOrReplaceTempView(name)
    return out


class _Guard:
    """Rebuilds an analysed plan with a least number of records under each top aggregate."""

    def __init__(self, spark: SparkSession, least: int):
        self.jvm, self.least = spark._jvm, least

    def seq(self, items: list[JavaObject]) -> JavaObject:
        return self.jvm.org.apache.spark.api.python.PythonUtils.toSeq(items)

    def make(self, name: str, *args) -> JavaObject:
        return _named(self.jvm, name)(*args)

    def alias(self, expression: JavaObject, name: str) -> JavaObject:
        new_id = _named(self.jvm, f"{_EXPRESSIONS}.NamedExpression").newExprId()
        return self.make(f"{_EXPRESSIONS}.Alias", expression, name, new_id, self.seq([]), self.jvm.scala.Option.empty(), self.seq([]))

    def above(self, node: JavaObject) -> JavaObject:
        """From the root down to the top aggregates."""
        kind = node.nodeName()
        if kind == "Aggregate":
            return self.top(node)
        children = _each(node.children())
        if kind in _LITERALS:
            return node
        if kind == "View" or not children:
            raise AccessDenied("this policy allows aggregates only")
        if kind not in _ABOVE:
            raise AccessDenied(f"{kind} is not allowed outside an aggregate")
        if any(not _literal(s) for s in _each(node.subqueries())):
            raise AccessDenied("sub-queries outside an aggregate are not allowed")
        return node.withNewChildren(self.seq([self.above(c) for c in children]))

    def top(self, node: JavaObject) -> JavaObject:
        child, records, plain = self.below(node.child())
        if not records:  # literals alone
            return node
        counts = []
        for k, record in enumerate(records):
            column = self.make(f"{_EXPRESSIONS}.Literal", 1, self.jvm.org.apache.spark.sql.types.DataTypes.IntegerType) if plain else record
            count = self.make(f"{_EXPRESSIONS}.aggregate.Count", self.seq([column])).toAggregateExpression(not plain, self.jvm.scala.Option.empty())
            counts.append(self.alias(count, f"_records_{k}"))
        counted = self.make(f"{_PLANS}.Aggregate", node.groupingExpressions(), self.seq(_each(node.aggregateExpressions()) + counts), child, node.hint())
        for count in counts:
            least = self.make(f"{_EXPRESSIONS}.Literal", self.least, self.jvm.org.apache.spark.sql.types.DataTypes.IntegerType)
            wide = self.make(f"{_EXPRESSIONS}.Cast", least, self.jvm.org.apache.spark.sql.types.DataTypes.LongType, self.jvm.scala.Option.empty(), _named(self.jvm, f"{_EXPRESSIONS}.EvalMode").LEGACY())
            counted = self.make(f"{_PLANS}.Filter", self.make(f"{_EXPRESSIONS}.GreaterThanOrEqual", count.toAttribute(), wide), counted)
        return self.make(f"{_PLANS}.Project", node.output(), counted)

    def below(self, node: JavaObject) -> tuple[JavaObject, list[JavaObject], bool]:
        """The node with its records in the output; those records; and whether each row is a record of its own."""
        kind, children = node.nodeName(), _each(node.children())
        if kind == "View":
            return node, [a for a in _each(node.output()) if a.name() == RECORD], True
        if kind in _LITERALS:
            return node, [], True
        if kind == "Project":
            child, records, plain = self.below(children[0])
            named = _each(node.projectList())
            mine = {e.exprId().id() for e in named}
            more = [r for r in records if r.exprId().id() not in mine]
            return self.make(f"{_PLANS}.Project", self.seq(named + more), child), records, plain
        if kind == "Aggregate":
            child, records, _ = self.below(children[0])
            least = [self.alias(self.make(f"{_EXPRESSIONS}.aggregate.Min", r).toAggregateExpression(), RECORD) for r in records]
            out = self.make(f"{_PLANS}.Aggregate", node.groupingExpressions(), self.seq(_each(node.aggregateExpressions()) + least), child, node.hint())
            return out, [a.toAttribute() for a in least], False
        if kind == "Join":
            (left, l_records, _), (right, r_records, _) = map(self.below, children)
            whole = node.joinType().toString() not in ("LeftSemi", "LeftAnti")
            return node.withNewChildren(self.seq([left, right])), l_records + (r_records if whole else []), False
        if kind in _THROUGH:
            child, records, plain = self.below(children[0])
            out = node.withNewChildren(self.seq([child]))
            visible = {a.exprId().id() for a in _each(out.output())}
            if any(r.exprId().id() not in visible for r in records):
                raise AccessDenied(f"{kind} is not allowed under an aggregate")
            return out, records, plain and kind != "Generate"
        raise AccessDenied(f"{kind} is not allowed under an aggregate")


def _named(jvm, name: str):
    for part in name.split("."):
        jvm = getattr(jvm, part)
    return jvm


def _literal(plan: JavaObject) -> bool:
    return all(n.nodeName() != "View" and (_each(n.children()) or n.nodeName() in _LITERALS) for n in _parts(plan))


def analysed(session: SparkSession, query: str) -> JavaObject:
    """The analysed plan, common table expressions put in their places."""
    state = session._jsparkSession.sessionState()
    try:
        plan = state.executePlan(state.sqlParser().parsePlan(query), _named(session._jvm, "org.apache.spark.sql.execution.CommandExecutionMode").SKIP()).analyzed()
    except AnalysisException as e:
        raise AccessDenied(f"not allowed or unknown: {e}") from e
    return _named(session._jvm, "org.apache.spark.sql.catalyst.optimizer.InlineCTE")(True, False).apply(plan)


def governed_sql(spark: SparkSession, query: str, policy: str, relations: dict[str, Relation], grants: DataFrame | None = None, buyer: int | None = None, as_of: str | None = None) -> DataFrame:
    """The query's rows under a policy: reads only, over granted relations, small groups left out, at most its rows.

    ``grants`` (asset, buyer, status, valid_from, valid_until); without it all ``relations`` are granted.
    """
    if statement(spark, query) != "SELECT":
        raise AccessDenied("only SELECT is allowed")
    rules: Policy = POLICIES.get(policy, POLICIES["read_only"])
    session = governed_session(spark, relations, grants, buyer, as_of)
    plan = analysed(session, query)
    if rules.aggregates_only or rules.least_group > 1:
        plan = _Guard(session, rules.least_group).above(plan)
    rows = DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)
    return first_rows(rows, rules.most_rows) if rules.most_rows else rows
