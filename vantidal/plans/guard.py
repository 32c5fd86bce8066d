"""One read-only SELECT over named results: a statement is parsed by Spark and its plan checked node by node.

The plan is walked before analysis, so nothing is resolved, read or run until every node, expression, function and
relation is allowed; the plan that was checked is the one that runs. Plan classes, expression classes and functions are on
allow-lists: what isn't known is refused.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from vantidal.errors import Refusal
from vantidal.plans import compat

MOST_CHARS = 20_000
MOST_REWRITTEN = 20 * MOST_CHARS
MOST_RESULTS = 8

#: Plan classes that a query may consist of.
PLANS = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedWith"
    " UnresolvedRelation UnresolvedInlineTable OneRowRelation UnresolvedHaving WithWindowDefinition Generate LateralJoin"
    " UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction LocalRelation Sample UnresolvedTVFAliases".split()
)
#: Expression classes of the parser that compute from their children alone.
EXPRESSIONS = frozenset(
    "Add AggregateExpression Alias And AnyValue BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Collate Concat CreateNamedStruct Cube CurrentRow Divide EqualNullSafe"
    " EqualTo Exists GreaterThan GreaterThanOrEqual GroupingSets ILike If In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction LateralSubquery LessThan LessThanOrEqual"
    " Like LikeAll LikeAny ListQuery Literal MultiAlias Multiply Not NotLikeAll NotLikeAny Or Overlay RLike Remainder Rollup ScalarSubquery SemiStructuredExtract SortOrder"
    " SpecifiedWindowFrame StringLocate StringTrim StringTrimLeft StringTrimRight StringTrimBoth Substring Subtract TimestampAdd TimestampDiff UnaryMinus UnaryPositive"
    " UnboundedFollowing UnboundedPreceding UnresolvedAlias UnresolvedAttribute UnresolvedCollation UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator"
    " UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedWindowExpression UnspecifiedFrame WindowExpression"
    " WindowSpecDefinition AttributeReference Between UnresolvedInlineTable".split()
)
SUBQUERIES = frozenset("ScalarSubquery Exists ListQuery LateralSubquery".split())
#: Table functions that read no files and no settings.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
#: Groups of Spark's built-in functions that compute from their arguments alone. The group of files, classes, settings and the
#: session (misc_funcs) isn't among them.
GROUPS = frozenset(
    "math_funcs agg_funcs generator_funcs datetime_funcs array_funcs string_funcs map_funcs predicate_funcs bitwise_funcs variant_funcs window_funcs json_funcs"
    " conversion_funcs lambda_funcs conditional_funcs csv_funcs url_funcs xml_funcs hash_funcs struct_funcs collection_funcs".split()
)
#: Of other groups or none.
FUNCTIONS = frozenset("typeof struct named_struct grouping grouping_id date timestamp double decimal string int bigint boolean float binary".split())
#: Of those groups, but not of the arguments alone.
DENIED = frozenset("schema_of_xml schema_of_json schema_of_csv raise_error assert_true".split())
#: Names that Spark takes for a function of the session where no column is called so.
SESSION_NAMES = frozenset("current_user session_user user current_catalog current_database current_schema current_path".split())


@dataclass
class Checked:
    """A statement that may run: what it reads, and its text for Spark."""

    sql: str
    results: list[str] = field(default_factory=list)
    plan: object = None


def _scala(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _class(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _is(node, kind: str) -> bool:
    return _class(node) == kind


class _Walk:
    def __init__(self, spark: SparkSession, live: set[str]):
        self.live = {x.lower() for x in live}
        self.used: dict[str, None] = {}
        jvm = spark._jvm.org.apache.spark.sql.catalyst
        self.registry, self.identifier = jvm.analysis.FunctionRegistry.builtin(), jvm.FunctionIdentifier

    def group(self, name: str) -> str:
        """The group of a built-in function; empty for others."""
        found = self.registry.lookupFunction(self.identifier(name))
        return found.get().getGroup() if found.isDefined() else ""

    def plan(self, node, names: frozenset[str]) -> None:
        kind = _class(node)
        if kind in ("Pivot", "Unpivot", "UnpivotTransformer"):
            raise Refusal("sql_forbidden", "PIVOT and UNPIVOT aren't allowed.", "Use max(x) FILTER (WHERE ...) or a union.")
        if kind not in PLANS:
            outer = kind.endswith(("Command", "Statement")) or kind.startswith(("Create", "Drop", "Insert", "Set", "Show", "Alter", "Describe"))
            raise Refusal("sql_not_select" if outer else "sql_forbidden", f"{kind} isn't allowed.", "Write one SELECT.")
        if kind == "UnresolvedWith":
            # A name is in scope for the definitions after it, for its own if it is recursive, and for the query.
            known = names
            recursive = bool(node.allowRecursion()) if "allowRecursion" in dir(node) else "RECURSIVE" in str(node)
            for pair in _scala(node.cteRelations()):
                name = pair._1().lower()
                self.plan(pair._2(), known | {name} if recursive else known)
                known = known | {name}
            self.plan(node.child(), known)
            return
        if kind == "UnresolvedRelation":
            parts = _scala(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in names | self.live:
                raise Refusal("sql_table", f"'{'.'.join(parts)}' is no result of this session.", "Name a result or a WITH query.")
            if parts[0].lower() not in names:
                self.used[parts[0].lower()] = None
                if len(self.used) > MOST_RESULTS:
                    raise Refusal("sql_too_many_results", f"A query reads {MOST_RESULTS} results at most.")
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(_scala(node.name())).lower()
            if name not in TABLE_FUNCTIONS:
                raise Refusal("sql_function", f"The table function {name} isn't allowed.")
        for e in _scala(node.expressions()):
            self.expression(e, names)
        for child in _scala(node.children()):
            self.plan(child, names)

    def expression(self, e, names: frozenset[str]) -> None:
        kind = _class(e)
        if kind not in EXPRESSIONS:
            what = "Parameters" if kind in ("NamedParameter", "PosParameter") else "IDENTIFIER" if "Identifier" in kind else kind or "That expression"
            raise Refusal("sql_function" if "Identifier" in kind else "sql_forbidden", f"{what} isn't allowed.")
        if kind == "UnresolvedFunction":
            parts = [p.lower() for p in _scala(e.nameParts())]
            self.function(parts)
        if kind == "UnresolvedGenerator":
            name = e.name()
            self.function(([name.database().get()] if name.database().isDefined() else []) + [name.funcName().lower()])
        if kind == "UnresolvedAttribute":
            parts = _scala(e.nameParts())
            if len(parts) == 1 and parts[0].lower() in SESSION_NAMES:
                raise Refusal("sql_function", f"{parts[0]} isn't allowed.", f"For a column of that name write the result's name before it: r.{parts[0]}.")
        if kind in SUBQUERIES:
            self.plan(e.plan(), names)
        for child in _scala(e.children()):
            self.expression(child, names)

    def function(self, parts: list[str]) -> None:
        name = parts[-1]
        allowed = name in FUNCTIONS or name in compat.OWN_NAMES or (name not in DENIED and self.group(name) in GROUPS)
        if len(parts) > 1 or not allowed:
            raise Refusal("sql_function", f"The function {'.'.join(parts)} isn't allowed.")


@contextmanager
def _active(spark: SparkSession) -> Iterator[None]:
    """The parser reads the settings of the thread's active session."""
    jvm = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = jvm.getActiveSession()
    jvm.setActiveSession(spark._jsparkSession)
    try:
        yield
    finally:
        if before.isDefined():
            jvm.setActiveSession(before.get())
        else:
            jvm.clearActiveSession()


def check(spark: SparkSession, sql: str, live: set[str], most: int = MOST_CHARS) -> Checked:
    """Refuse what isn't one SELECT over live results; returns the statement and the results that it reads."""
    if not sql or not sql.strip() or "\0" in sql:
        raise Refusal("sql_empty", "There is no statement.")
    if len(sql) > most:
        raise Refusal("sql_too_long", f"A statement has {MOST_CHARS} characters at most{', and it grew too long when it was rewritten' if most > MOST_CHARS else ''}.")
    text = sql.strip()
    if len([p for p in compat.split(text, ";") if p.strip()]) > 1:
        raise Refusal("sql_multiple", "There are several statements.", "Send one.")
    text = text.rstrip("; \t\r\n")
    if not text:
        raise Refusal("sql_empty", "There is no statement.")
    compat.refuse_silent_joins(text)
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        with _active(spark):
            plan = parser.parsePlan(text)
    except ParseException as e:
        raise Refusal("sql_parse", first_line(str(e)), hint(str(e), text)) from None
    except Exception as e:  # the parser's Java errors
        raise Refusal("sql_parse", first_line(str(e)), hint(str(e), text)) from None
    walk = _Walk(spark, live)
    walk.plan(plan, frozenset())
    return Checked(text, list(walk.used), plan)


def checked_frame(spark: SparkSession, query: compat.Query, live: set[str]) -> DataFrame:
    """The rows of a rewritten statement, with the first of its choices that Spark can resolve. The checked plan is what runs."""
    error: Exception | None = None
    for picked in query.picks():
        text, starts = query.text(picked)
        try:
            df = _resolved(spark, text, live)
            if kinds := _rounded_kinds(df, text, starts):
                names = df.columns
                df = _resolved(spark, query.text([kinds.get(i, p) for i, p in enumerate(picked)])[0], live)
                df = df if df.columns == names else df.toDF(*names)
            return query.finish(df)
        except AnalysisException as e:
            if error is None or "DATATYPE_MISMATCH" not in str(e):
                error = e
            if "DATATYPE_MISMATCH" not in str(e) and "CAST" not in str(e):
                break
    raise error


def _resolved(spark: SparkSession, text: str, live: set[str]) -> DataFrame:
    checked = check(spark, text, live, MOST_REWRITTEN)
    compat.register_functions(spark, text)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, checked.plan), spark)


def _rounded_kinds(df: DataFrame, text: str, starts: dict[int, int]) -> dict[int, int]:
    """By place, the choice for a rounding of a double (1) or a float (2); of other types Spark's own stays."""
    kinds: dict[int, int] = {}

    def expression(e) -> None:
        own = _class(e)
        if own == "Round":
            o = e.origin()
            if o.startIndex().isDefined() and o.sqlText().isDefined() and o.sqlText().get() == text and o.startIndex().get() in starts:
                kind = {"double": 1, "float": 2}.get(e.child().dataType().simpleString())
                kinds.update({starts[o.startIndex().get()]: kind} if kind else {})
        if own in SUBQUERIES:
            plan(e.plan())
        if own != "AttributeReference":
            for child in _scala(e.children()):
                expression(child)

    def plan(node) -> None:
        if _is(node, "View"):  # a result, with roundings of its own
            return
        for e in _scala(node.expressions()):
            expression(e)
        for child in _scala(node.children()):
            plan(child)

    if starts:
        plan(df._jdf.queryExecution().analyzed())
    return kinds


def first_line(message: str) -> str:
    """An error's first line without paths and Java names."""
    line = next((x for x in message.splitlines() if x.strip()), "")
    return re.sub(r"(?:[a-z]+://|/)[\w./-]{4,}", "...", re.sub(r"^[\w.$]+(?:Exception|Error):?\s*", "", line))[:300]


#: Words that Spark reserves or that people expect to be names.
KEYWORDS = frozenset("select from where group order by having limit table end start user date time interval window values".split())


def hint(message: str, sql: str) -> str | None:
    """What to do about a common mistake."""
    low = message.lower()
    if "missing_aggregation" in low or "not in group by" in low or "missing_group_by" in low:
        return "Add the column to GROUP BY, or use GROUP BY ALL."
    if "unresolved_column" in low:
        return "Check the column names of the result."
    if "divide_by_zero" in low:
        return "Use try_divide(a, b)."
    if "parse_syntax_error" in low and (m := re.search(r"near '(\w+)'", message)) and m[1].lower() in KEYWORDS:
        return f"If {m[1]} is a name, write it in backquotes."
    return None


#: Names in double quotes, exact arithmetic, literals as the rewriter writes them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.parser.escapedStringLiterals": "false", "spark.sql.legacy.consecutiveStringLiterals.enabled": "false", "spark.sql.crossJoin.enabled": "true",
}


def run(spark: SparkSession, sql: str, results: dict[str, DataFrame], most: int | None = 200) -> DataFrame:
    """The checked statement's rows, one more than `most` so that a reader sees that there are more (None: all).

    The statement is rewritten in Spark's terms first; results are temporary views of a session of its own, so
    statements see nothing else.
    """
    if sql and len(sql) > MOST_CHARS:
        raise Refusal("sql_too_long", f"A statement has {MOST_CHARS} characters at most.")
    if not sql or not sql.strip("; \t\r\n") or "\0" in sql:
        raise Refusal("sql_empty", "There is no statement.")
    if len([p for p in compat.split(sql, ";") if p.strip()]) > 1:
        raise Refusal("sql_multiple", "There are several statements.", "Send one.")
    own = spark.newSession()
    for key, value in SETTINGS.items():
        own.conf.set(key, value)
    for name, df in results.items():
        _move(df, own).createOrReplaceTempView(name)
    query = compat.rewrite(own, sql)
    try:
        out = checked_frame(own, query, set(results) | set(query.views))
        return out if most is None else out.limit(most + 1)
    except Refusal:
        raise
    except Exception as e:
        raise Refusal("sql_error", first_line(str(e)), hint(str(e), sql)) from None


def rows_within(df: DataFrame, seconds: float) -> list:
    """The rows, or a refusal once the time is over; the query's jobs are then cancelled on the cluster."""
    context, tag = df.sparkSession.sparkContext, f"query-{uuid.uuid4().hex}"
    over, done = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            over.set()
            while not done.wait(0.2):  # jobs that start later are cancelled too
                context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        return df.collect()
    except Exception as e:
        if over.is_set():
            raise Refusal("sql_timeout", f"The query took more than {seconds:g} seconds.", "Read less, or aggregate.") from None
        raise Refusal("sql_error", first_line(str(e)), hint(str(e), "")) from None
    finally:
        done.set()
        context.removeJobTag(tag)


def _move(df: DataFrame, session: SparkSession) -> DataFrame:
    """The same plan in another session of the same application."""
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan()), session)
