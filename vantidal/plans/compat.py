"""SQL of an analytic dialect, rewritten in Spark's terms before parsing.

The text is cut into tokens and nested groups. Each query level is rewritten by itself, the innermost first: ASOF JOIN,
QUALIFY and UNION BY NAME; nulls last in every ORDER BY; `x[1]` counting from 1, `[a, b]` and `{'a': x}`, `x::type`, `/`, `//`,
`^`, `->>`; and functions of the same name with another meaning, or of another name with the same. What depends on types that
only the analyzer knows (`len` of texts and lists, casts to whole numbers) is tried in turn.

`a ASOF JOIN b` and `a POSITIONAL JOIN b` would parse in Spark as inner joins with odd aliases, so they are
found among the tokens: the first is rewritten to the as-of operator, the second refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.errors import Refusal
from vantidal.functions.timeframes import ORIGIN_MICROS

_TOKEN = re.compile(
    r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?!\w)|\w+|\s+"
    r"|::|->>|->|//|\*\*|<=>|<=|>=|<>|!=|==|\|\||\|>|:=|.", re.S,
)
#: A token, or a group: the opening sign, its tokens and groups, the closing sign.
Node = "str | list"
CLOSING = {"(": ")", "[": "]", "{": "}"}


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _blank(t: str) -> bool:
    return t.isspace() or t.startswith(("--", "/*"))


def split(sql: str, at: str) -> list[str]:
    """Parts between separators that stand outside quotes, comments and parentheses."""
    out, depth, part = [], 0, []
    for t in tokens(sql):
        depth += (t == "(") - (t == ")")
        if t == at and depth == 0:
            out.append("".join(part))
            part = []
        else:
            part.append(t)
    return [*out, "".join(part)]


def tree(sql: str) -> list:
    """Tokens without blanks and comments, those between brackets nested."""
    stack: list[list] = [[]]
    for t in tokens(sql):
        if _blank(t):
            continue
        if t in "'\"`":
            raise Refusal("sql_parse", f"A quote ({t}) isn't closed.")
        if t in CLOSING:
            stack.append([t])
        elif t in CLOSING.values():
            if len(stack) == 1 or CLOSING[stack[-1][0]] != t:
                raise Refusal("sql_parse", f"'{t}' closes nothing.")
            group = stack.pop()
            stack[-1].append([*group, t])
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise Refusal("sql_parse", f"'{stack[-1][0]}' isn't closed.")
    return stack[0]


def _up(node: Node) -> str:
    return node.upper() if isinstance(node, str) else ""


def _group(node: Node, sign: str = "(") -> bool:
    return isinstance(node, list) and node[0] == sign


def _is_query(node: Node) -> bool:
    return _group(node) and len(node) > 2 and (_up(node[1]) in ("SELECT", "WITH", "FROM", "VALUES") or _is_query(node[1]))


def _cut(seq: list, at: str = ",") -> list[list]:
    out: list[list] = [[]]
    for t in seq:
        if t == at:
            out.append([])
        else:
            out[-1].append(t)
    return out if len(out) > 1 or out[0] else []


def _quoted(t: Node) -> bool:
    return isinstance(t, str) and t.startswith("'") and len(t) > 1


def _literal(text: str) -> str:
    """A literal of Spark's, in which a backslash escapes."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _content(literal: str) -> str:
    """What a literal of Spark's stands for."""
    return re.sub(r"\\(.)", r"\1", literal[1:-1], flags=re.S)


def _spark(t: str) -> str:
    """A literal of the dialect (only quotes are doubled) as one of Spark's."""
    return _literal(t[1:-1].replace("''", "'"))


def refuse_silent_joins(sql: str) -> None:
    """Refuse joins that Spark would take for an alias and answer wrongly, and piped clauses."""
    found = [t.upper() for t in tokens(sql) if not _blank(t)]
    if "|>" in found:
        raise Refusal("sql_not_select", "Pipes (|>) aren't allowed.", "Write one SELECT.")
    for a, b in zip(found, found[1:], strict=False):
        if a in ("ASOF", "POSITIONAL") and b in ("JOIN", "LEFT", "INNER"):
            raise Refusal("sql_forbidden", f"{a} JOIN isn't available here.", "Use ASOF JOIN between two named results, or the align operator.")


@dataclass
class Query:
    """Rewritten text, views that were made for it, and what is done to its rows."""

    sql: str
    views: list[str] = field(default_factory=list)
    steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    choices: list[list[str]] = field(default_factory=list)  #: by place in the text, what may stand there
    rounds: set[int] = field(default_factory=set)  #: places of roundings: Spark's own, of doubles, of floats

    def finish(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df

    def picks(self) -> Iterator[list[int]]:
        """Combinations of choices (64 at most), the likeliest first, with Spark's own rounding."""
        yield from (list(p) for p in islice(product(*(range(1 if i in self.rounds else len(c)) for i, c in enumerate(self.choices))), 64))

    def text(self, picked: list[int]) -> tuple[str, dict[int, int]]:
        """The text with a choice at each place, and where in it Spark's own roundings begin: their places."""
        text = self.sql
        for i in reversed(range(len(picked))):  # an outer choice may hold inner ones, whose numbers are smaller
            text = text.replace(f"\0{i}\0", self.choices[i][picked[i]])
        out, starts = "", {}
        for part in re.split("(\0@\\d+\0)", text):
            if part.startswith("\0@"):
                starts[len(out)] = int(part[2:-1])
            else:
                out += part
        return out, starts


def _rounded(x: str, n: int) -> str:
    """round of a double: it is scaled, rounded and scaled back, so a half is told after scaling; what gets too large stays as
    it is. (Spark's own rounds the digits that are written for the number.)"""
    most = "double('Infinity')"
    if abs(n) > 308:  # the scale is infinite
        near = "v" if n > 0 else f"CASE WHEN abs(v) < {most} THEN 0D ELSE v END"
    else:
        to, back = ("*", "/") if n >= 0 else ("/", "*")
        scaled = f"v {to} 1E{abs(n)}D"
        whole = f"CASE WHEN abs({scaled} - rint({scaled})) = 0.5D THEN {scaled} + sign(v) * 0.5D ELSE rint({scaled}) END"  # of halves rint takes the even one
        near = f"(({whole}) {back} 1E{abs(n)}D)"
        near = f"CASE WHEN abs({near}) < {most} THEN {near} ELSE v END"
    return f"element_at(transform(array({x}), v -> {near}), 1)"


def register_functions(spark: SparkSession, sql: str) -> None:
    """The temporary SQL functions that a text calls, once a session; Catalyst puts their bodies in place."""
    known = spark.__dict__.setdefault("_own_functions", set())
    called = set(re.findall(r"\w+(?=\()", sql.lower()))
    for head, body in OWN.items():
        if (name := head.partition("(")[0]) in called and name not in known:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
            known.add(name)


OWN = {
    "time_bucket(width INTERVAL DAY TO SECOND, ts TIMESTAMP) RETURNS TIMESTAMP": f"timestamp_micros(unix_micros(ts) - pmod(unix_micros(ts) - {ORIGIN_MICROS}L, cast(round(extract(DAY FROM width) * 86400000000 + extract(HOUR FROM width) * 3600000000 + extract(MINUTE FROM width) * 60000000 + extract(SECOND FROM width) * 1000000) AS bigint)))",
    "epoch(ts TIMESTAMP) RETURNS DOUBLE": "unix_micros(ts) / 1000000",
    "isfinite(x DOUBLE) RETURNS BOOLEAN": "NOT isnan(x) AND abs(x) < double('Infinity')",
    "isinf(x DOUBLE) RETURNS BOOLEAN": "abs(x) = double('Infinity')",
    "to_seconds(n DOUBLE) RETURNS INTERVAL DAY TO SECOND": "make_dt_interval(0, 0, 0, cast(n AS decimal(18, 6)))",
    "to_minutes(n INT) RETURNS INTERVAL DAY TO SECOND": "make_dt_interval(0, 0, n)",
    "to_hours(n INT) RETURNS INTERVAL DAY TO SECOND": "make_dt_interval(0, n)",
    "to_days(n INT) RETURNS INTERVAL DAY TO SECOND": "make_dt_interval(n)",
    "to_months(n INT) RETURNS INTERVAL YEAR TO MONTH": "make_ym_interval(0, n)",
    "regexp_full_match(s STRING, p STRING) RETURNS BOOLEAN": "s RLIKE concat('^(?:', p, ')$')",
}
OWN_NAMES = frozenset(head.partition("(")[0] for head in OWN)

# --- Functions -----------------------------------------------------------------------------------

#: Another name for the same.
RENAMED = {
    "list_contains": "array_contains", "list_has": "array_contains", "list_filter": "filter", "list_transform": "transform", "list_has_any": "arrays_overlap",
    "list_concat": "concat", "list_reverse": "reverse", "list_min": "array_min", "list_max": "array_max", "list_position": "array_position", "list_append": "array_append",
    "list_zip": "arrays_zip", "list_value": "array", "list_sort": "array_sort", "list_extract": "try_element_at", "array_extract": "try_element_at",
    "array_length": "size", "strlen": "octet_length", "strpos": "instr", "starts_with": "startswith", "prefix": "startswith", "ends_with": "endswith", "suffix": "endswith",
    "regexp_matches": "regexp_like", "string_split_regex": "split", "regexp_split_to_array": "split", "quantile_cont": "percentile", "approx_quantile": "approx_percentile",
    "kurtosis_pop": "kurtosis", "json_keys": "json_object_keys", "json_extract_path_text": "get_json_object", "unnest": "explode", "today": "current_date", "favg": "avg", "fsum": "sum",
}
#: strftime's letters in Spark's patterns.
FORMATS = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "g": "SSS", "j": "DDD", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "p": "a", "I": "hh", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
}
MICROS = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}


def time_pattern(literal: str) -> str:
    """A strftime format as a pattern literal."""
    out, text = "", _content(literal)
    for part in re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", text, re.S):
        if part[0] == "%":
            if part[1] == "%":
                out += "%"
            elif part[1] in FORMATS:
                out += FORMATS[part[1]]
            else:
                raise Refusal("sql_function", f"The format {part} isn't known.")
        else:
            out += f"'{part}'" if part[0].isalpha() else part.replace("'", "''")
    return _literal(out)


@dataclass
class Call:
    """A function call whose arguments are rewritten already."""

    name: str
    args: list[str]
    order: list[tuple[str, bool]]  #: ORDER BY inside the parentheses: expression, whether descending
    suffix: str  #: FILTER, WITHIN GROUP and OVER
    distinct: bool = False
    in_from: bool = False

    def agg(self, name: str, *args: str) -> str:
        """An aggregate or window function with this call's suffix."""
        return f"{name}({'DISTINCT ' if self.distinct else ''}{', '.join(args)}){self.suffix}"


def _by_extreme(c: Call, largest: bool) -> str:
    if len(c.args) != 2:
        raise Refusal("sql_function", f"{c.name} takes a value and what it is ordered by.")
    return c.agg("max_by" if largest else "min_by", c.args[0], f"CASE WHEN ({c.args[0]}) IS NOT NULL THEN {c.args[1]} END")


def _one_way(c: Call) -> bool:
    ways = {desc for _, desc in c.order}
    if len(ways) > 1:
        raise Refusal("sql_function", f"{c.name} is ordered in one direction.")
    return ways.pop()


def _end(c: Call, last: bool) -> str:
    """first and last: of rows in order, nulls count and stand last."""
    if not c.order:
        return c.agg(c.name, *c.args)
    desc = _one_way(c)
    keys = [f"{k} IS {'NOT ' if desc else ''}NULL, {k}" for k, _ in c.order]
    pick = "min_by" if desc == last else "max_by"
    return c.agg(pick, f"named_struct('v', {c.args[0]})", f"struct({', '.join(keys)})") + ".v"


def _listed(c: Call) -> str:
    """A list keeps nulls; of no rows it is null."""
    fields = "".join(f"'n{i}', {k} IS {'NOT ' if d else ''}NULL, 'k{i}', {k}, " for i, (k, d) in enumerate(c.order))
    if c.distinct:
        got = c.agg("collect_list", c.args[0])
        got = f"sort_array({got})" if c.order else got
    else:
        got = c.agg("collect_list", f"named_struct({fields}'v', {c.args[0]})")
        got = f"transform({f'sort_array({got}, {str(not _one_way(c)).lower()})' if c.order else got}, s -> s.v)"
    return f"CASE WHEN size({got}) > 0 THEN {got} END"


def _joined(c: Call) -> str:
    order = ", ".join(f"{k} {'DESC' if d else 'ASC'} NULLS LAST" for k, d in c.order)
    within = f" WITHIN GROUP (ORDER BY {order})" if order else ""
    return f"listagg({'DISTINCT ' if c.distinct else ''}{c.args[0]}, {c.args[1] if len(c.args) > 1 else _literal(',')}){within}{c.suffix}"


def _date_diff(c: Call) -> str:
    if len(c.args) != 3 or not _quoted(c.args[0]):
        return f"datediff({', '.join(c.args)})"
    unit, a, b = _content(c.args[0]).lower().rstrip("s"), *c.args[1:]
    if unit in ("day", "week"):
        return f"datediff({b}, {a})" if unit == "day" else f"(datediff({b}, {a}) DIV 7)"
    if unit in MICROS:
        at = lambda x: f"floor(unix_micros(CAST({x} AS TIMESTAMP)) / {MICROS[unit]})"
        return f"({at(b)} - {at(a)})"
    at = {
        "month": lambda x: f"(year({x}) * 12 + month({x}))",
        "quarter": lambda x: f"(year({x}) * 4 + quarter({x}))", "year": lambda x: f"year({x})",
    }.get(unit)
    if at is None:
        raise Refusal("sql_function", f"date_diff knows no {unit}.")
    return f"({at(b)} - {at(a)})"


def _substr(c: Call) -> str:
    if len(c.args) != 3:
        return f"substr({', '.join(c.args)})"
    s, at, n = c.args
    if re.fullmatch(r"[1-9]\d*", at):
        return f"substr({s}, {at}, {n})"
    return f"substr({s}, CASE WHEN {at} = 0 THEN 1 ELSE {at} END, CASE WHEN {at} = 0 THEN {n} - 1 ELSE {n} END)"


def _replaced(c: Call) -> str:
    """regexp_replace replaces the first match, with the option g all; groups are \\1."""
    if len(c.args) not in (3, 4) or len(c.args) == 4 and c.args[3] != "'g'":
        raise Refusal("sql_function", "regexp_replace takes a text, a pattern, a replacement and the option 'g'.")
    s, p, r = c.args[:3]
    if _quoted(r):
        r = _literal(re.sub(r"\\(\d)", r"$\1", _content(r).replace("$", "\\$")))
    if len(c.args) == 4:
        return f"regexp_replace({s}, {p}, {r})"
    at, hit = f"regexp_instr({s}, {p})", f"regexp_substr({s}, {p})"
    return f"CASE WHEN {at} = 0 THEN {s} ELSE concat(substr({s}, 1, {at} - 1), regexp_replace({hit}, {p}, {r}), substr({s}, {at} + length({hit}))) END"


def _json_path(p: str) -> str:
    return _literal("$." + _content(p)) if _quoted(p) and not _content(p).startswith("$") else p


def _skewness(c: Call) -> str:
    n, x = c.agg("count", c.args[0]), c.agg("skewness", c.args[0])
    return f"CASE WHEN {n} > 2 THEN {x} * sqrt({n} * ({n} - 1)) / ({n} - 2) END"


def _kurtosis(c: Call) -> str:
    n, x = c.agg("count", c.args[0]), c.agg("kurtosis", c.args[0])
    return f"CASE WHEN {n} > 3 THEN (({n} + 1) * {x} + 6) * ({n} - 1) / (({n} - 2) * ({n} - 3)) END"


def _corr(c: Call) -> str:
    a, b = c.args
    pair = lambda x: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({x} AS DOUBLE) END"
    varies = " AND ".join(f"{c.agg('min', pair(x))} < {c.agg('max', pair(x))}" for x in (a, b))  # the spread of a constant isn't always 0
    value = f"try_divide({c.agg('covar_pop', a, b)}, {c.agg('stddev_pop', pair(a))} * {c.agg('stddev_pop', pair(b))})"
    return f"coalesce(CASE WHEN {varies} THEN {value} END, CASE WHEN {c.agg('count', pair(a))} > 0 THEN double('NaN') END)"


def _log(form: str, x: str) -> str:
    """A logarithm of 0 is -Infinity and one of a negative number NaN, where Spark's are null."""
    return f"coalesce({form}, CASE WHEN {x} = 0 THEN double('-Infinity') WHEN {x} < 0 THEN double('NaN') END)"


def _log_of_base(c: Call) -> str:
    if len(c.args) == 1:
        return _log(f"log10({c.args[0]})", c.args[0])
    base, x = c.args
    return _log(f"log({base}, {x})", x) if re.fullmatch(r"[2-9]|[1-9]\d+", base) else f"({_log(f'ln({x})', x)} / ln({base}))"


def _geometric(c: Call) -> str:
    return f"exp({c.agg('avg', _log(f'ln({c.args[0]})', c.args[0]))})"


def _split_at(c: Call) -> str:
    """The separator is text, not a pattern."""
    quote = _literal("\\Q"), _literal("\\E")
    return f"split({c.args[0]}, concat({quote[0]}, {c.args[1]}, {quote[1]}), -1)"


def _series(c: Call) -> str:
    a, b, *step = c.args if len(c.args) > 1 else ("0", *c.args)
    if c.name == "generate_series":
        made = f"sequence({', '.join([a, b, *step])})"
    else:
        made = f"CASE WHEN {b} > {a} THEN sequence({', '.join([a, f'{b} - 1', *step])}) ELSE array() END"
    return f"(SELECT explode({made}) AS {c.name})" if c.in_from else made


def _plain(form: str) -> Callable[[Call], str]:
    """A form with {0}, {1}, ... for the arguments."""
    return lambda c: form.format(*(f"({a})" if re.search(r"[^\w.']", a) else a for a in c.args), all=", ".join(c.args))


#: Calls that mean something else in Spark, or are made of others.
CALLS: dict[str, Callable[[Call], str]] = {
    "arg_max": lambda c: _by_extreme(c, True), "argmax": lambda c: _by_extreme(c, True), "max_by": lambda c: _by_extreme(c, True),
    "arg_min": lambda c: _by_extreme(c, False), "argmin": lambda c: _by_extreme(c, False), "min_by": lambda c: _by_extreme(c, False),
    "first": lambda c: _end(c, False), "last": lambda c: _end(c, True), "any_value": lambda c: c.agg("any_value", c.args[0], "true"),
    "list": _listed, "array_agg": _listed, "string_agg": _joined, "group_concat": _joined, "listagg": _joined,
    "quantile_disc": lambda c: f"percentile_disc({c.args[1]}) WITHIN GROUP (ORDER BY {c.args[0]}){c.suffix}",
    "quantile": lambda c: f"percentile_disc({c.args[1]}) WITHIN GROUP (ORDER BY {c.args[0]}){c.suffix}",
    "skewness": _skewness, "kurtosis": _kurtosis, "corr": _corr,
    "product": lambda c: f"aggregate({c.agg('collect_list', f'CAST({c.args[0]} AS DOUBLE)')}, CAST(1 AS DOUBLE), (a, b) -> a * b)",
    "geometric_mean": _geometric, "geomean": _geometric, "ln": lambda c: _log(f"ln({c.args[0]})", c.args[0]),
    "log": _log_of_base, "log10": lambda c: _log(f"log10({c.args[0]})", c.args[0]), "log2": lambda c: _log(f"log2({c.args[0]})", c.args[0]),
    "string_split": _split_at, "str_split": _split_at,
    "split": _split_at, "string_to_array": _split_at,
    "substr": _substr, "substring": _substr, "regexp_replace": _replaced,
    "regexp_extract": lambda c: f"regexp_extract({', '.join(c.args if len(c.args) > 2 else [*c.args, '0'])})",
    "regexp_extract_all": lambda c: f"regexp_extract_all({', '.join(c.args if len(c.args) > 2 else [*c.args, '0'])})",
    "concat": _plain("concat_ws('', {all})"),
    "trunc": lambda c: f"CASE WHEN {c.args[0]} < 0 THEN ceil({c.args[0]}) ELSE floor({c.args[0]}) END", "xor": _plain("({0} ^ {1})"),
    "list_distinct": _plain("array_distinct(array_compact({0}))"), "list_unique": _plain("size(array_distinct(array_compact({0})))"),
    "list_sum": _plain("aggregate({0}, CAST(0 AS DOUBLE), (a, b) -> a + coalesce(b, 0))"), "list_prepend": _plain("array_prepend({1}, {0})"),
    "list_slice": _plain("slice({0}, {1}, greatest({2} - {1} + 1, 0))"), "struct_extract": lambda c: f"{c.args[0]}[{c.args[1]}]",
    "strftime": lambda c: f"date_format({c.args[0]}, {time_pattern(c.args[1])})", "strptime": lambda c: f"to_timestamp({c.args[0]}, {time_pattern(c.args[1])})",
    "try_strptime": lambda c: f"try_to_timestamp({c.args[0]}, {time_pattern(c.args[1])})",
    "date_diff": _date_diff, "datediff": _date_diff, "date_add": lambda c: f"(CAST({c.args[0]} AS TIMESTAMP) + {c.args[1]})", "dayofweek": _plain("(dayofweek({0}) - 1)"),
    "weekday": _plain("(dayofweek({0}) - 1)"), "isodow": _plain("(weekday({0}) + 1)"), "monthname": _plain("date_format({0}, 'MMMM')"), "dayname": _plain("date_format({0}, 'EEEE')"),
    "epoch_ms": _plain("(round(unix_micros(CAST({0} AS TIMESTAMP)), -3) DIV 1000)"), "epoch_us": _plain("unix_micros(CAST({0} AS TIMESTAMP))"),
    "to_timestamp": lambda c: f"timestamp_seconds({c.args[0]})" if len(c.args) == 1 else f"to_timestamp({', '.join(c.args)})",
    "date_part": lambda c: _part(_content(c.args[0]), c.args[1]) if _quoted(c.args[0]) else f"date_part({', '.join(c.args)})",
    "json_extract_string": lambda c: f"get_json_object({c.args[0]}, {_json_path(c.args[1])})",
    "json_extract": lambda c: f"to_json(variant_get(parse_json({c.args[0]}), {_json_path(c.args[1])}))", "json_valid": _plain("(try_parse_json({0}) IS NOT NULL)"),
    "generate_series": _series, "range": _series, "corr_pop": _corr,
}
#: Whose meaning depends on the argument's type: the length of a text or a list.
BY_TYPE = {"len": ("length({0})", "size({0})"), "length": ("length({0})", "size({0})")}


def _part(unit: str, of: str) -> str:
    unit = unit.lower()
    own = {"epoch": "epoch({})", "dow": "(dayofweek({}) - 1)", "dayofweek": "(dayofweek({}) - 1)", "weekday": "(dayofweek({}) - 1)", "isodow": "(weekday({}) + 1)"}
    return own[unit].format(of) if unit in own else f"date_part('{unit}', {of})"


# --- Expressions -----------------------------------------------------------------------------------

#: Words that begin no operand.
KEYWORDS = frozenset(
    "SELECT DISTINCT ALL FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET AS ON USING JOIN LEFT RIGHT FULL INNER OUTER CROSS NATURAL SEMI ANTI LATERAL VIEW"
    " UNION INTERSECT EXCEPT WITH RECURSIVE AND OR NOT IN IS LIKE ILIKE RLIKE BETWEEN ESCAPE WHEN THEN ELSE END ASC DESC NULLS OVER PARTITION ROWS PRECEDING"
    " FOLLOWING UNBOUNDED CURRENT WINDOW FILTER WITHIN QUALIFY VALUES TABLESAMPLE REPEATABLE EXCLUDE SETS ROLLUP CUBE EXISTS ANY SOME DIV LAMBDA FETCH ASOF".split()
)
#: Of these the ones that are functions before a parenthesis.
ALSO_FUNCTIONS = frozenset("LEFT RIGHT ANY SOME DIV".split())
#: Ends an ORDER BY.
AFTER_ORDER = frozenset("LIMIT OFFSET FETCH ROWS RANGE GROUPS UNION INTERSECT EXCEPT WINDOW QUALIFY USING".split())
UNITS = frozenset("YEAR YEARS MONTH MONTHS WEEK WEEKS DAY DAYS HOUR HOURS MINUTE MINUTES SECOND SECONDS MILLISECOND MILLISECONDS MICROSECOND MICROSECONDS TO".split())
TYPES = {
    "VARCHAR": "STRING", "TEXT": "STRING", "BPCHAR": "STRING", "UUID": "STRING", "HUGEINT": "DECIMAL(38,0)", "UHUGEINT": "DECIMAL(38,0)", "UBIGINT": "DECIMAL(20,0)", "UINTEGER": "BIGINT",
    "USMALLINT": "INT", "UTINYINT": "SMALLINT", "INTEGER": "INT", "INT4": "INT", "INT32": "INT", "INT8": "BIGINT", "INT64": "BIGINT", "LONG": "BIGINT", "FLOAT8": "DOUBLE", "REAL": "FLOAT",
    "FLOAT4": "FLOAT", "TIMESTAMPTZ": "TIMESTAMP", "DATETIME": "TIMESTAMP", "BOOL": "BOOLEAN", "BLOB": "BINARY", "BYTEA": "BINARY", "NUMERIC": "DECIMAL",
}
WHOLE = frozenset(("TINYINT", "SMALLINT", "INT", "BIGINT"))


def _type(seq: list) -> str:
    """A type's name in Spark; `X[]` is a list of X."""
    if not seq:
        raise Refusal("sql_parse", "A cast needs a type.")
    text = TYPES.get(_up(seq[0]), _flat(seq[:1]))
    for t in seq[1:]:
        if _group(t, "["):
            text = f"ARRAY<{text}>"
        elif _up(t) in ("WITH", "TIME", "ZONE", "PRECISION"):
            continue
        elif _group(t):
            text = text if text == "STRING" else text + _flat([t])
        else:
            text += " " + _flat([t])
    return text


def _flat(seq: list) -> str:
    """The tokens as they are."""
    out = ""
    for t in seq:
        s = t[0] + _flat(t[1:-1]) + t[-1] if isinstance(t, list) else t
        tight = not out or s[0] in ".,([" or out[-1] in ".(["
        out += s if tight else " " + s
    return out


class Rewriter:
    def __init__(self, spark: SparkSession, query: Query):
        self.spark, self.made = spark, query

    # Queries

    def query(self, seq: list) -> str:
        """One query level: its tokens without the parentheses around them."""
        if len(seq) == 1 and _is_query(seq[0]):
            return f"({self.query(seq[0][1:-1])})"
        return self.run(self._qualified(self._distinct_on(self._asof(seq))))

    def _distinct_on(self, seq: list) -> list:
        """SELECT DISTINCT ON (keys): the first row of each key in the query's order."""
        ups = [_up(t) for t in seq]
        at = next((i for i in range(len(seq) - 3) if ups[i : i + 3] == ["SELECT", "DISTINCT", "ON"] and _group(seq[i + 3])), None)
        if at is None:
            return seq
        order = next((i for i in range(at, len(seq) - 1) if ups[i : i + 2] == ["ORDER", "BY"]), None)
        end = next((i for i in range(at, len(seq)) if ups[i] in ("ORDER", "LIMIT", "OFFSET")), len(seq))
        stop = next((i for i in range(order, len(seq)) if ups[i] in ("LIMIT", "OFFSET")), len(seq)) if order is not None else None
        keys = seq[at + 3][1:-1]
        window = ["(", "PARTITION", "BY", *keys, *(seq[order:stop] if order is not None else ["ORDER", "BY", *keys]), ")"]
        return [*seq[: at + 1], *seq[at + 4 : end], "QUALIFY", "row_number", ["(", ")"], "OVER", window, "=", "1", *seq[end:]]

    def _qualified(self, seq: list) -> list:
        ups = [_up(t) for t in seq]
        if "QUALIFY" not in ups:
            return seq
        at = ups.index("QUALIFY")
        start = max((i for i in range(at) if ups[i] == "SELECT"), default=None)
        start_from = next((i for i in range(start or 0, at) if ups[i] == "FROM"), None)
        if start is None or start_from is None:
            raise Refusal("sql_parse", "QUALIFY needs SELECT and FROM.")
        stops = ("ORDER", "LIMIT", "OFFSET", "WINDOW", "UNION", "INTERSECT", "EXCEPT")
        end = next((i for i in range(at, len(seq)) if ups[i] in stops), len(seq))
        window, tail = [], seq[end:]
        if tail and _up(tail[0]) == "WINDOW":  # the inner query's own
            stop = next((i for i in range(1, len(tail)) if _up(tail[i]) in stops), len(tail))
            window, tail = tail[:stop], tail[stop:]
        inner = ["(", *seq[start:start_from], ",", ["(", *seq[at + 1 : end], ")"], "AS", "__qualify", *seq[start_from:at], *window, ")"]
        out = [*seq[:start], "SELECT", "*", "EXCEPT", ["(", "__qualify", ")"], "FROM", inner, "WHERE", "__qualify", *tail]
        return self._qualified(out)

    def _asof(self, seq: list) -> list:
        """FROM a [AS x] ASOF [LEFT] JOIN b [AS y] ON x.k = y.k AND x.t >= y.t: a view with a struct for each side."""
        from vantidal.operators.asof import asof_join

        ups = [_up(t) for t in seq]
        at = next((i for i in range(len(seq) - 1) if ups[i] == "ASOF" and ups[i + 1] in ("JOIN", "LEFT", "INNER")), None)
        if at is None:
            return seq
        from_ = max((i for i in range(at) if ups[i] == "FROM"), default=None)
        keeps_left = ups[at + 1] == "LEFT"
        join = at + 1 if ups[at + 1] == "JOIN" else at + 2
        on = next((i for i in range(join, len(seq)) if ups[i] == "ON"), None)
        left = [t for t in seq[(from_ or 0) + 1 : at] if _up(t) != "AS"]
        right = [t for t in seq[join + 1 : on] if _up(t) != "AS"] if on else []
        if from_ is None or on is None or ups[join] != "JOIN" or not all(isinstance(t, str) for t in left + right) or not 1 <= len(left) <= 2 or not 1 <= len(right) <= 2:
            raise Refusal("sql_parse", "ASOF JOIN stands between two named results: FROM a ASOF [LEFT] JOIN b ON ...")
        stops = ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "QUALIFY", "WINDOW", "OFFSET", "UNION", "JOIN", "LEFT", "INNER", "CROSS", "ASOF", "INTERSECT", "EXCEPT")
        end = next((i for i in range(on, len(seq)) if ups[i] in stops), len(seq))
        x, y = left[-1], right[-1]
        by, clock = [], None
        for part in re.split(r"(?i)\s+AND\s+", " ".join(_flat([t]) for t in seq[on + 1 : end]).replace(" . ", ".")):
            m = re.fullmatch(r"\(?\s*(\w+)\.(\w+)\s*(=|>=|<=|>|<)\s*(\w+)\.(\w+)\s*\)?", part.strip())
            if not m or {m[1].lower(), m[4].lower()} != {x.lower(), y.lower()}:
                raise Refusal("sql_parse", "ASOF conditions are x.a = y.b and one inequality of times.")
            a, op, b = (m[2], m[3], m[5]) if m[1].lower() == x.lower() else (m[5], {"=": "=", ">=": "<=", "<=": ">=", ">": "<", "<": ">"}[m[3]], m[2])
            if op == "=":
                by.append((a, b))
            elif clock is None:
                clock = (a, b, "backward" if op[0] == ">" else "forward", len(op) == 1)
            else:
                raise Refusal("sql_parse", "ASOF needs one inequality.")
        if clock is None:
            raise Refusal("sql_parse", "ASOF needs an inequality of times.")
        lhs, rhs = (self._table(t[0]) for t in (left, right))
        l_one = lhs.select(F.struct("*").alias("__x"), *(F.col(a).alias(f"__a{i}") for i, (a, _) in enumerate(by)), F.col(clock[0]).alias("__lt"))
        r_one = rhs.select(F.struct("*").alias("__y"), *(F.col(b).alias(f"__b{i}") for i, (_, b) in enumerate(by)), F.col(clock[1]).alias("__rt"))
        keys = [(f"__a{i}", f"__b{i}") for i in range(len(by))]
        out = asof_join(l_one, r_one, "__lt", "__rt", keys, clock[2], right_columns=["__y"], strict=clock[3])
        # Names that only one side has may be used without the side's.
        plain = [F.col(f"__{s}.`{c}`").alias(c) for s, own, other in (("x", lhs, rhs), ("y", rhs, lhs)) for c in own.columns if c not in other.columns and c not in (x, y)]
        out = out.select(F.col("__x").alias(x), F.col("__y").alias(y), *plain)
        if not keeps_left:
            out = out.filter(F.col(f"`{y}`").isNotNull())
        view = f"__asof{len(self.made.views)}"
        out.createOrReplaceTempView(view)
        self.made.views.append(view)
        head = seq[:from_]
        select = max((i for i in range(from_) if ups[i] == "SELECT"), default=None)
        if select is not None and [t for t in head[select + 1 :] if _up(t) != "DISTINCT"] == ["*"]:
            head = [*head[:-1], x, ".", "*", ",", y, ".", "*"]
        return self._asof([*head, "FROM", view, *seq[end:]])

    def _table(self, name: str) -> DataFrame:
        live = {t.name.lower() for t in self.spark.catalog.listTables() if t.isTemporary}
        if name.strip('`"').lower() not in live:
            raise Refusal("sql_table", f"'{name}' is no result of this session.", "Name a result.")
        return self.spark.table(name.replace('"', "`"))

    # Expressions

    def run(self, seq: list) -> str:
        out: list[str] = []
        i, ended = 0, False  # whether an operand ended here, so that a minus subtracts
        while i < len(seq):
            t, up = seq[i], _up(seq[i])
            if up == "ORDER" and i + 1 < len(seq) and _up(seq[i + 1]) == "BY":
                end = next((k for k in range(i + 2, len(seq)) if _up(seq[k]) in AFTER_ORDER and not (k + 1 < len(seq) and _group(seq[k + 1]) and _up(seq[k]) == "RANGE")), len(seq))
                out.append("ORDER BY " + ", ".join(self._sort_item(item) for item in _cut(seq[i + 2 : end])))
                i = end
            elif up in ("EXCLUDE", "EXCEPT") and out and (out[-1] == "*" or out[-1].endswith(".*")):
                names = seq[i + 1]
                out.append(f"EXCEPT {_flat([names])}" if _group(names) else f"EXCEPT ({names})")
                i += 2
            elif up == "REPLACE" and out and (out[-1] == "*" or out[-1].endswith(".*")) and i + 1 < len(seq) and _group(seq[i + 1]):
                items = _cut(seq[i + 1][1:-1])
                out.append(f"EXCEPT ({', '.join(_flat(x[-1:]) for x in items)}), {', '.join(self.run(x) for x in items)}")
                i += 2
            elif up == "SIMILAR" and i + 2 < len(seq) and _up(seq[i + 1]) == "TO":
                text, i = self._term(seq, i + 2)
                out.append(f"RLIKE concat('^(?:', {text}, ')$')")
            elif up == "FETCH" and i + 2 < len(seq) and _up(seq[i + 1]) in ("FIRST", "NEXT"):
                out.append(f"LIMIT {_flat(seq[i + 2 : i + 3])}")
                i += next((k + 1 for k in range(len(seq) - i) if _up(seq[i + k]) == "ONLY"), 3)
            elif up == "LAMBDA":  # lambda x, y: body
                colon = seq.index(":", i) if ":" in seq[i:] else None
                if colon is None:
                    raise Refusal("sql_parse", "lambda needs a colon.")
                names = _cut(seq[i + 1 : colon])
                out.append(f"({', '.join(_flat(n) for n in names)}) ->" if len(names) > 1 else f"{_flat(names[0])} ->")
                i = colon + 1
            elif self._operand(seq, i) or t == "-" and not ended and self._operand(seq, i + 1):
                text, i = self._term(seq, i, bool(out) and out[-1].upper() in ("FROM", "JOIN", "LATERAL"))
                out.append(text)
                ended = True
                continue
            else:
                out.append(t if isinstance(t, str) else self._nested(t))
                i += 1
            ended = False
        text = ""
        for s in out:
            text += s if not text or s in (",", ".", ";") or text[-1] == "." else " " + s
        return text

    def _sort_item(self, item: list) -> str:
        text = self.run(item)
        return text if any(_up(t) == "NULLS" for t in item) else text + " NULLS LAST"

    def _nested(self, g: list) -> str:
        inner = g[1:-1]
        return f"({self.query(inner) if _is_query(g) else self.run(inner)})"

    def _operand(self, seq: list, i: int) -> bool:
        if i >= len(seq):
            return False
        t = seq[i]
        if isinstance(t, list):
            return True
        if t[0] in "'\"`" or t[0].isdigit() or (t[0] == "." and len(t) > 1):
            return True
        if not (t[0].isalpha() or t[0] == "_"):
            return False
        up = t.upper()
        if up in KEYWORDS:
            return up in ALSO_FUNCTIONS and i + 1 < len(seq) and _group(seq[i + 1]) and not (up in ("LEFT", "RIGHT") and _is_query(seq[i + 1]))
        return True

    def _term(self, seq: list, i: int, in_from: bool = False) -> tuple[str, int]:
        text, i = self._power(seq, i, in_from)
        while i < len(seq) and seq[i] in ("*", "/", "//", "%"):
            op, k = seq[i], i + 1
            if k < len(seq) and seq[k] == "+":
                k += 1
            if not self._operand(seq, k + (seq[k : k + 1] == ["-"])):
                break
            right, i = self._power(seq, k)
            if op == "/":
                text = f"coalesce(try_divide(CAST({text} AS DOUBLE), {right}), CAST({text} AS DOUBLE) * double('Infinity') + {right})"
            else:
                text = f"{text} {'DIV' if op == '//' else op} {right}"
        return text, i

    def _power(self, seq: list, i: int, in_from: bool = False) -> tuple[str, int]:
        """Powers; a sign belongs to what follows it before any operation: -x ^ 2 is the square of -x."""
        if seq[i] == "-":
            text, i = self._primary(seq, i + 1)
            text = f"-{text}" if text[0].isdigit() or text[0] == "." else f"(- {text})"
        else:
            text, i = self._primary(seq, i, in_from)
        while i < len(seq) and seq[i] in ("^", "**"):
            sign, k = ("-", i + 2) if i + 1 < len(seq) and seq[i + 1] == "-" else ("", i + 1)
            if not self._operand(seq, k):
                break
            right, i = self._primary(seq, k)
            text = f"pow({text}, {sign}{right})"
        return text, i

    def _primary(self, seq: list, i: int, in_from: bool = False) -> tuple[str, int]:
        t, up = seq[i], _up(seq[i])
        after = seq[i + 1] if i + 1 < len(seq) else ""
        if isinstance(t, list):
            inner, i = t[1:-1], i + 1
            if t[0] == "(":
                text = self._nested(t)
            elif t[0] == "[":
                text = f"array({', '.join(self.run(x) for x in _cut(inner))})"
            else:
                pairs = [_cut(x, ":") for x in _cut(inner)]
                if any(len(p) != 2 for p in pairs):
                    raise Refusal("sql_parse", "A struct is {'name': value, ...}.")
                text = f"named_struct({', '.join(f'{self._name(k)}, {self.run(v)}' for k, v in pairs)})"
        elif up == "MAP" and _group(after, "{"):
            pairs = [_cut(x, ":") for x in _cut(after[1:-1])]
            if any(len(p) != 2 for p in pairs):
                raise Refusal("sql_parse", "A map is MAP {key: value, ...}.")
            text, i = f"map({', '.join(f'{self.run(k)}, {self.run(v)}' for k, v in pairs)})", i + 2
        elif up == "CASE":
            depth, k = 1, i + 1
            while k < len(seq) and depth:
                depth += (_up(seq[k]) == "CASE") - (_up(seq[k]) == "END")
                k += 1
            if depth:
                raise Refusal("sql_parse", "CASE has no END.")
            text, i = f"CASE {self.run(seq[i + 1 : k - 1])} END", k
        elif up == "INTERVAL" and (_quoted(after) or isinstance(after, str) and after[:1].isdigit() or _group(after)):
            k = i + 2
            while k < len(seq) and _up(seq[k]) in UNITS:
                k += 1
            value = self._nested(after) if isinstance(after, list) else _spark(after) if _quoted(after) else after
            text, i = " ".join(["INTERVAL", value, *seq[i + 2 : k]]), k
        elif up in ("DATE", "TIMESTAMP", "TIMESTAMPTZ", "TIMESTAMP_NTZ", "X") and _quoted(after):
            text, i = f"{'TIMESTAMP' if up == 'TIMESTAMPTZ' else t} {_spark(after)}", i + 2
        elif t[0] in "'" or t[0].isdigit() or t[0] == ".":
            text, i = _spark(t) if t[0] == "'" else t, i + 1
        else:
            text, i = t, i + 1
            while i + 1 < len(seq) and seq[i] == "." and isinstance(seq[i + 1], str):
                text, i = f"{text}.{seq[i + 1]}", i + 2
            if i < len(seq) and _group(seq[i]) and t[0] not in "\"`":
                text, i = self._call(text, seq[i], seq, i + 1, in_from)
        return self._postfix(text, seq, i)

    def _name(self, seq: list) -> str:
        return _spark(seq[0]) if _quoted(seq[0]) else _literal(_flat(seq).strip('"`'))

    def _choice(self, *texts: str) -> str:
        self.made.choices.append(list(texts))
        return f"\0{len(self.made.choices) - 1}\0"

    def _round(self, x: str, n: int) -> str:
        place = len(self.made.choices)
        self.made.rounds.add(place)
        return self._choice(f"\0@{place}\0round({x}, {n})", _rounded(x, n), f"CAST({_rounded(f'CAST({x} AS DOUBLE)', n)} AS FLOAT)")

    def _cast(self, text: str, kind: str, name: str = "CAST") -> str:
        """A cast to whole numbers rounds (floating numbers half to even); what can't be rounded (truth values) is cast as it is."""
        plain = f"{name}({text} AS {kind})"
        near = f"CASE WHEN typeof({text}) IN ('double', 'float') THEN bround({text}) ELSE round({text}) END"
        return self._choice(f"{name}({near} AS {kind})", plain) if kind.upper() in WHOLE and not re.fullmatch(r"\d+", text) else plain

    def _postfix(self, text: str, seq: list, i: int) -> tuple[str, int]:
        while i < len(seq):
            t = seq[i]
            if _group(t, "["):
                inner, i = t[1:-1], i + 1
                if ":" in inner:
                    a, z = (self.run(p) if p else "" for p in (_cut(inner, ":") + [[], []])[:2])
                    a = a or "1"
                    text = f"slice({text}, {a}, greatest({z or f'size({text})'} - {a} + 1, 0))"
                elif len(inner) == 1 and _quoted(inner[0]):
                    text = f"{text}[{_spark(inner[0])}]"
                else:
                    text = f"try_element_at({text}, {self.run(inner)})"
            elif t == "::":
                k = i + 2
                while k < len(seq) and (_group(seq[k], "[") and len(seq[k]) == 2 or k == i + 2 and _group(seq[k])):
                    k += 1
                text, i = self._cast(text, _type(seq[i + 1 : k])), k
            elif t == "." and i + 1 < len(seq) and isinstance(seq[i + 1], str) and seq[i + 1] != "*":
                text, i = f"{text}.{seq[i + 1]}", i + 2
            elif t in ("->>", "->") and i + 1 < len(seq) and _quoted(seq[i + 1]):
                path = _json_path(_spark(seq[i + 1]))
                text = f"get_json_object({text}, {path})" if t == "->>" else f"to_json(variant_get(parse_json({text}), {path}))"
                i += 2
            else:
                break
        return text, i

    def _call(self, name: str, group: list, seq: list, i: int, in_from: bool) -> tuple[str, int]:
        inner, low = group[1:-1], name.lower()
        suffix = ""
        while i < len(seq):
            up, nxt = _up(seq[i]), seq[i + 1] if i + 1 < len(seq) else ""
            if up == "FILTER" and _group(nxt):
                suffix, i = f"{suffix} FILTER {self._nested(nxt)}", i + 2
            elif up == "WITHIN" and _up(nxt) == "GROUP" and i + 2 < len(seq):
                suffix, i = f"{suffix} WITHIN GROUP {self._nested(seq[i + 2])}", i + 3
            elif up in ("IGNORE", "RESPECT") and _up(nxt) == "NULLS":
                suffix, i = f"{suffix} {up} NULLS", i + 2
            elif up == "OVER":
                suffix, i = f"{suffix} OVER {self._nested(nxt) if _group(nxt) else nxt}", i + 2
            else:
                break
        ups = [_up(t) for t in inner]
        if low in ("cast", "try_cast") and "AS" in ups:
            at = len(ups) - 1 - ups[::-1].index("AS")
            return self._cast(self.run(inner[:at]), _type(inner[at + 1 :]), low.upper()), i
        if low == "extract" and "FROM" in ups[:2]:
            return _part(_flat(inner[:1]), self.run(inner[2:])), i
        if _is_query(group):
            return f"{name} {self._nested(group)}{suffix}", i
        order: list[tuple[str, bool]] = []
        for k in range(len(ups) - 1):
            if ups[k] == "ORDER" and ups[k + 1] == "BY":
                for item in _cut(inner[k + 2 :]):
                    words = [t for t in item if _up(t) not in ("ASC", "DESC", "NULLS", "FIRST", "LAST")]
                    order.append((self.run(words), any(_up(t) == "DESC" for t in item)))
                inner = inner[:k]
                break
        if ups[-2:] in (["IGNORE", "NULLS"], ["RESPECT", "NULLS"]):
            suffix, inner = f" {ups[-2]} NULLS{suffix}", inner[:-2]
        distinct = bool(inner) and _up(inner[0]) == "DISTINCT"
        args = [self.run(a) for a in _cut(inner[1:] if distinct else inner)]
        c = Call(low, args, order, suffix, distinct, in_from)
        if low == "count" and not args:
            args = ["*"]
        if low in BY_TYPE and len(args) == 1:
            return self._choice(*(form.format(args[0]) for form in BY_TYPE[low])), i
        if low == "round" and len(args) == 2 and (digits := re.fullmatch(r"(-?) ?(\d{1,4})", args[1])):
            return self._round(args[0], int(digits[1] + digits[2])), i
        try:
            if low in CALLS:
                return CALLS[low](c), i
        except (IndexError, ValueError):
            raise Refusal("sql_function", f"{name} has too few or too many arguments.") from None
        if low == "unnest" and in_from:
            return f"(SELECT explode({', '.join(args)}) AS unnest)", i
        return f"{RENAMED.get(low, name)}({'DISTINCT ' if distinct else ''}{', '.join(args)}){suffix}", i


# --- Statements ------------------------------------------------------------------------------------


def _sample(query: Query) -> None:
    m = re.search(r"(?i)\s+USING\s+SAMPLE\s+(?:reservoir\s*\(\s*)?(\d+(?:\.\d+)?)\s*(%|PERCENT|ROWS?)?\s*\)?\s*(?:REPEATABLE\s*\(\s*(\d+)\s*\))?\s*$", query.sql)
    if not m:
        return
    n, unit, seed = float(m[1]), (m[2] or "ROWS").upper(), int(m[3] or 42)
    query.sql = query.sql[: m.start()]
    if unit in ("%", "PERCENT"):
        query.steps.append(lambda df: df.sample(fraction=n / 100, seed=seed))
    else:  # the rows of least seeded hash: the same on every run
        query.steps.append(lambda df: df.orderBy(F.xxhash64(F.lit(seed), *(c for c, k in df.dtypes if not k.startswith("map")))).limit(int(n)))


def _percent(query: Query) -> None:
    m = re.search(r"(?i)\s+LIMIT\s+(\d+(?:\.\d+)?)\s*(?:%|PERCENT)\s*$", query.sql)
    if m:
        share = float(m[1])
        query.sql = query.sql[: m.start()]
        query.steps.append(lambda df: df.limit(int(df.count() * share / 100)))


def rewrite(spark: SparkSession, sql: str) -> Query:
    """The statement in Spark's terms; what can't be read is refused."""
    try:
        return _rewrite(spark, sql)
    except RecursionError:
        raise Refusal("sql_parse", "The statement is nested too deeply.") from None
    except (IndexError, ValueError, KeyError) as e:
        raise Refusal("sql_parse", f"The statement can't be read ({type(e).__name__}).") from None


def _rewrite(spark: SparkSession, sql: str) -> Query:
    query = Query((sql or "").strip().rstrip("; \t\r\n"))
    _sample(query)
    _percent(query)
    seq = tree(query.sql)
    branches, every = _by_name(seq)
    if len(branches) > 1:
        return _union_by_name(spark, query, branches, every)
    query.sql = Rewriter(spark, query).query(seq)
    return query


def _by_name(seq: list) -> tuple[list[list], list[bool]]:
    """The branches of UNION [ALL] BY NAME, and whether each further one keeps repeated rows."""
    ups = [_up(t) for t in seq]
    branches, every, start = [], [], 0
    for i in range(len(seq)):
        k = i + 2 if ups[i : i + 2] == ["UNION", "ALL"] else i + 1
        if ups[i] == "UNION" and ups[k : k + 2] == ["BY", "NAME"]:
            branches.append(seq[start:i])
            every.append(k == i + 2)
            start = k + 2
    return [*branches, seq[start:]], every


def _union_by_name(spark: SparkSession, query: Query, branches: list[list], every: list[bool]) -> Query:
    """Each branch becomes a view with the columns of all branches, in the order in which they first appear."""
    from vantidal.plans.guard import checked_frame

    live = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    frames = []
    for n, seq in enumerate(branches):
        branch = Query("", views=[f"__none{n}"] * (10 * (n + 1)))  # names of its own for its views
        branch.sql = Rewriter(spark, branch).query(seq)
        frames.append(checked_frame(spark, branch, live | set(branch.views)))
    out = frames[0]
    for keep, f in zip(every, frames[1:], strict=True):
        out = out.unionByName(f, allowMissingColumns=True)
        out = out if keep else out.distinct()
    view = "__by_name"
    out.createOrReplaceTempView(view)
    query.views.append(view)
    query.sql = f"SELECT * FROM {view}"
    return query
