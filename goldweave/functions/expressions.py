"""Expressions in documents: a safety check, PostgreSQL spelling to Spark's, and curated predicates and transforms."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    pass


_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<string>'(?:[^']|'')*')|(?P<ident>"(?:[^"]|"")*"|[A-Za-z_][A-Za-z_0-9]*)|(?P<number>[0-9]+(?:\.[0-9]+)?)|(?P<op>::|->>|->|\|\||<=|>=|<>|!=|[-+*/%=<>(),.;\[\]])""",
    re.X,
)
#: Words that have no place in a scalar expression.
FORBIDDEN = {"insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "copy", "execute", "call", "merge"}
QUERY = {"select", "from", "join", "union", "with"}
_TYPES = {"numeric": "decimal(38,18)", "decimal": "decimal(38,18)", "text": "string", "varchar": "string", "string": "string", "integer": "int", "int": "int", "bigint": "bigint", "boolean": "boolean", "bool": "boolean", "timestamptz": "timestamp", "timestamp": "timestamp", "datetime": "timestamp", "date": "date", "double": "double", "float": "double", "jsonb": "string", "json": "string"}
_RENAMED = {"string_agg": "listagg", "now": "current_timestamp", "jsonb_array_length": "json_array_length", "btrim": "trim"}
#: Functions whose call is written otherwise; {0} stands for the arguments.
_REWRITTEN = {
    "jsonb_each_text": "explode(from_json({0}, 'map<string,string>'))",
    "jsonb_array_elements_text": "explode(from_json({0}, 'array<string>'))",
    "jsonb_object_keys": "explode(json_object_keys({0}))",
    "jsonb_object_agg": "to_json(map_from_entries(collect_list(struct({0}))))",
    "jsonb_agg": "to_json(collect_list({0}))",
    "jsonb_build_object": "to_json(named_struct({0}))",
    "jsonb_build_array": "to_json(array({0}))",
}
_REWRITTEN |= {n.replace("jsonb", "json"): t for n, t in _REWRITTEN.items()}
#: Letters of date formats, and Spark's.
_DATE_LETTERS = {"YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DDD": "D", "DD": "dd", "DAY": "EEEE", "DY": "EEE", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Q": "Q", "TZ": "z"}
_DATE_FORMATTED = ("to_char", "to_date", "to_timestamp")


def date_format(pattern: str) -> str | None:
    """Spark's form of a date format (between its quotes); None for a format of numbers."""
    pattern = pattern.removeprefix("FM")
    if not re.search("YY|MM|DD|HH|MI|SS|DAY|DY|MON|Q", pattern.upper()):
        return None
    out, at = "", 0
    while at < len(pattern):
        if pattern[at] == '"':
            end = pattern.find('"', at + 1)
            end = len(pattern) if end < 0 else end
            out += "''" + pattern[at + 1 : end] + "''"
            at = end + 1
            continue
        known = next((k for k in sorted(_DATE_LETTERS, key=len, reverse=True) if pattern[at : at + len(k)].upper() == k), None)
        if known is None:
            out += f"''{pattern[at]}''" if pattern[at].isalpha() else pattern[at]
        else:
            out += _DATE_LETTERS[known]
        at += len(known) if known else 1
    return out


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ExpressionError(f"unexpected {text[at]!r}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


def check_expression(text: str, query: bool = False) -> None:
    """Raise unless ``text`` is one balanced expression without statements (or, unless ``query``, subqueries)."""
    if text.count("'") % 2:
        raise ExpressionError("unbalanced quotes")
    depth = 0
    for kind, t in tokens(text):
        depth += (t == "(") - (t == ")")
        if depth < 0:
            break
        if t == ";":
            raise ExpressionError("';' is not allowed")
        if kind == "ident" and t.lower() in (FORBIDDEN if query else FORBIDDEN | QUERY):
            raise ExpressionError(f"{t!r} is not allowed")
        if kind == "ident" and t.startswith("_") and not query and t.startswith(("_written_", "_cluster_members_", "_fwd_", "_id_", "_rev_")):
            raise ExpressionError(f"internal name {t!r}")
    if depth:
        raise ExpressionError("unbalanced parentheses")


_DECIMAL_TEXT = "regexp_replace(regexp_replace(cast({0} AS string), '([.][0-9]*?)0+$', '$1'), '[.]$', '')"


def to_spark(text: str) -> str:
    """Spark SQL for a PostgreSQL expression: casts, JSON arrows, quoted names and renamed functions."""
    toks = tokens(text)
    out: list[str] = []
    primary = 0  # where the last operand starts in out
    stack: list[tuple[int, str]] = []
    numeric = False
    path: tuple[int, str, list[str]] | None = None  # operand start, operand, JSON steps
    i = 0
    while i < len(toks):
        kind, t = toks[i]
        if t == "::":
            name = toks[i + 1][1].lower()
            i += 2
            size: list[str] = []
            if i < len(toks) and toks[i][1] == "(":  # numeric(10, 2), varchar(5)
                while toks[i][1] != ")":
                    size += [toks[i][1]] * (toks[i][0] == "number")
                    i += 1
                i += 1
            operand = " ".join(out[primary:])
            if size and name in ("numeric", "decimal"):
                out[primary:] = [f"try_cast({operand} AS decimal({size[0]},{size[1] if len(size) > 1 else 0}))"]
                numeric = False  # its scale is its own, so its zeros stay
            elif size and _TYPES.get(name) == "string":
                out[primary:] = [f"left(cast({operand} AS string), {size[0]})"]
                numeric = False
            elif _TYPES.get(name) == "string":
                out[primary:] = [_DECIMAL_TEXT.format(operand) if numeric else f"cast({operand} AS string)"]
                numeric = False
            elif name in _TYPES:
                out[primary:] = [f"try_cast({operand} AS {_TYPES[name]})"]
                numeric = name in ("numeric", "decimal")
            else:
                raise ExpressionError(f"unknown type {name!r}")
            path = None
            continue
        if t in ("->", "->>"):
            step_kind, step = toks[i + 1]
            if path is None or path[0] != primary:
                path = (primary, " ".join(out[primary:]), [])
            path[2].append(f"[{step}]" if step_kind == "number" else "[" + step.replace("''", "'").replace("'", '"') + "]")
            steps = "".join(path[2]).replace('["', "['").replace('"]', "']").replace("'", "\\'")
            out[primary:] = [f"get_json_object({path[1]}, '${steps}')"]
            numeric = False
            i += 2
            continue
        if t == "(":
            called = bool(i) and toks[i - 1][0] == "ident" and toks[i - 1][1].lower() not in ("and", "or", "not", "in", "when", "then", "else", "is", "like", "between", "case", "where", "select", "from")
            stack.append((len(out) - 1 if called else len(out), toks[i - 1][1].lower() if called else ""))
            out.append("(")
            primary = len(out)
        elif t == ")":
            start, called = stack.pop()
            out.append(")")
            if called == "trunc":
                args = " ".join(out[start + 2 : -1])
                value, _, digits = args.rpartition(",") if "," in args else (args, "", "0")
                scale = int(digits)
                out[start:] = [f"cast({value} - ({value}) % {'1' if not scale else '0.' + '0' * (scale - 1) + '1'} AS decimal(38,{scale}))"]
                numeric = True
            elif called in _REWRITTEN:
                out[start:] = [_REWRITTEN[called].format(" ".join(out[start + 2 : -1]))]
                numeric = False
            elif called == "regexp_replace" and out[-3:-1] == [",", "'g'"]:
                out[-3:] = [")"]  # all occurrences are replaced in any case
                numeric = False
            else:
                numeric = False
            primary = start
        elif kind == "ident":
            if t.startswith('"'):
                t = "`" + t[1:-1].replace('""', '"').replace("`", "``") + "`"
            elif t.lower() in _RENAMED:
                t = _RENAMED[t.lower()]
            if not (out and out[-1] == "."):
                primary = len(out)
            out.append(t)
            numeric = False
        elif kind == "string" and stack and stack[-1][1] in _DATE_FORMATTED and out[-1] == ",":
            primary = len(out)
            pattern = date_format(t[1:-1])
            if pattern is not None and stack[-1][1] == "to_char":
                out[stack[-1][0]] = "date_format"
            out.append(f"'{pattern}'" if pattern is not None else "'" + t[1:-1].removeprefix("FM") + "'")
            numeric = False
        elif kind in ("string", "number"):
            primary = len(out)
            out.append(t.replace("\\", "\\\\") if kind == "string" else t)
            numeric = False
        else:
            out.append(t)
            if t != ".":
                primary = len(out)
        i += 1
    return " ".join(out).replace(" . ", ".")


def expression(text: str) -> Column:
    check_expression(text)
    return F.expr(to_spark(text))


def pick(value: Any) -> Any:
    """The Spark side of an escape hatch keyed by backend."""
    return value["sql"] if isinstance(value, dict) and set(value) <= {"sql", "sparql"} else value


def predicate(spec: Any, column) -> Column:
    """A predicate from SQL text or from a curated form; NULL counts as false.

    Curated: one of equals, not_equals, gt, gte, lt, lte ``{field, value}``, in
    ``{field, values}``, not_null, is_null ``{field}``, and, or (lists), not, or
    the escape hatch ``{sql: text}``.  ``column`` gives the column of a name.
    """
    spec = pick(spec)
    if isinstance(spec, str):
        return F.coalesce(expression(spec), F.lit(False))
    return F.coalesce(_curated(spec, column), F.lit(False))


def descendants(hierarchy: dict[str, str]) -> dict[str, list[str]]:
    """Every value of a child-to-parent map with itself and all that lies below it; a circle is an error."""
    out: dict[str, list[str]] = {}
    for value in {*hierarchy, *hierarchy.values()}:
        at, seen = value, []
        while at is not None:
            if at in seen:
                raise ExpressionError(f"{value!r} lies below itself")
            seen.append(at)
            out.setdefault(at, []).append(value)
            at = hierarchy.get(at)
    return {k: sorted(v) for k, v in out.items()}


def with_descendants(spec: Any, hierarchies: dict[str, dict[str, str]]) -> Any:
    """A predicate in which a value of a field with a hierarchy also stands for all below it: in =, <>, IN and their curated forms."""
    spec = pick(spec)
    if not hierarchies or spec is None:
        return spec
    below = {f: descendants(h) for f, h in hierarchies.items()}
    if not isinstance(spec, str):
        (op, arg), *_ = spec.items()
        if op in ("and", "or"):
            return {op: [with_descendants(s, hierarchies) for s in arg]}
        if op == "not":
            return {op: with_descendants(arg, hierarchies)}
        held = below.get(arg["field"])
        if held is None or op not in ("equals", "not_equals", "in"):
            return spec
        wanted = {"in": {"field": arg["field"], "values": list(dict.fromkeys(v for x in (arg["values"] if op == "in" else [arg["value"]]) for v in held.get(x, [x])))}}
        return {"not": wanted} if op == "not_equals" else wanted
    literal = lambda v: "'" + v.replace("'", "''") + "'"
    toks, out, i = [t for _, t in tokens(spec)], [], 0
    while i < len(toks):
        held = below.get(toks[i].strip('"'))
        after = [t.lower() for t in toks[i + 1 : i + 4]]
        if held is None or not after or (i and toks[i - 1] == "."):
            out.append(toks[i])
            i += 1
        elif after[0] in ("=", "<>", "!=") and after[1].startswith("'"):
            value = toks[i + 2][1:-1].replace("''", "'")
            out += [toks[i], "IN" if after[0] == "=" else "NOT IN", "(" + ", ".join(map(literal, held.get(value, [value]))) + ")"]
            i += 3
        elif "in" in after[:2] and (after[0] == "in" or after[0] == "not"):
            start = i + 3 + after.index("in")
            end = toks.index(")", start)
            values = [t[1:-1].replace("''", "'") for t in toks[start:end] if t.startswith("'")]
            out += toks[i:start] + [", ".join(map(literal, dict.fromkeys(v for x in values for v in held.get(x, [x]))))]
            i = end
        else:
            out.append(toks[i])
            i += 1
    return " ".join(out)


def predicate_names(spec: Any) -> list[str]:
    """The names that a predicate reads."""
    spec = pick(spec)
    if isinstance(spec, str):
        return names_in(spec)
    (op, arg), *_ = spec.items()
    if op in ("and", "or"):
        return list(dict.fromkeys(n for s in arg for n in predicate_names(s)))
    return predicate_names(arg) if op == "not" else [arg["field"]]


def _curated(spec: Any, column) -> Column:
    spec = pick(spec)
    if isinstance(spec, str):
        return expression(spec)
    if not isinstance(spec, dict) or len(spec) != 1:
        raise ExpressionError(f"one predicate is expected, not {spec!r}")
    (op, arg), *_ = spec.items()
    if op == "and":
        return reduce(lambda a, b: a & b, [_curated(s, column) for s in arg], F.lit(True))
    if op == "or":
        return reduce(lambda a, b: a | b, [_curated(s, column) for s in arg], F.lit(False))
    if op == "not":
        return ~_curated(arg, column)
    c = column(arg["field"])
    if op in ("not_null", "is_null"):
        return c.isNotNull() if op == "not_null" else c.isNull()
    if op == "in":
        return reduce(lambda a, b: a | b, [_compared(c, "equals", v) for v in arg["values"]], F.lit(False))
    return _compared(c, op, arg["value"])


def _compared(c: Column, op: str, value: Any) -> Column:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    side = c.cast("string").try_cast("decimal(38,18)") if number else c.cast("string")
    lit = F.lit(str(value)).cast("decimal(38,18)") if number else F.lit(str(value).lower() if isinstance(value, bool) else value)
    forms = {"equals": lambda: side == lit, "not_equals": lambda: side != lit, "gt": lambda: side > lit, "gte": lambda: side >= lit, "lt": lambda: side < lit, "lte": lambda: side <= lit}
    if op not in forms:
        raise ExpressionError(f"unknown predicate {op!r}")
    return forms[op]()


def normalized(name: str, spec: Any) -> Column:
    """The column ``name`` under a template with %s, or under a list of curated normalisers."""
    spec = pick(spec)
    if spec is None:
        return F.col(name)
    if isinstance(spec, str) and "%s" in spec:
        check_expression(spec.replace("%s", "_value"))
        return F.expr(re.sub(r"\b_value\b", f"`{name}`", to_spark(spec.replace("%s", "_value")))).cast("string")
    return reduce(_curated_step, spec if isinstance(spec, list) else [spec], F.col(name))


def _curated_step(c: Column, step: Any) -> Column:
    name, arg = next(iter(step.items())) if isinstance(step, dict) else (step, None)
    arg = arg or {}
    number = lambda: c.cast("string").try_cast("decimal(38,18)")
    if name in ("lowercase", "uppercase", "trim"):
        return {"lowercase": F.lower, "uppercase": F.upper, "trim": F.trim}[name](c)
    if name == "truncate" and "length" in arg:
        return F.left(c, F.lit(int(arg["length"])))
    if name == "truncate":
        unit = 10 ** int(arg["decimals"])
        n = number() * unit
        return numeric_text(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)) / F.lit(unit))
    if name == "round":
        return numeric_text(F.bround(number(), int(arg.get("decimals", 0))))
    if name == "pad":
        fill = F.rpad if arg.get("side") == "right" else F.lpad
        return fill(c, F.greatest(F.length(c), F.lit(int(arg["width"]))), F.lit(str(arg.get("char", " "))))
    if name == "clamp":
        n = number()
        n = F.greatest(n, F.lit(str(arg["min"])).cast("decimal(38,18)")) if "min" in arg else n
        n = F.least(n, F.lit(str(arg["max"])).cast("decimal(38,18)")) if "max" in arg else n
        return numeric_text(n)
    if name == "truncate_time":
        return F.date_trunc(arg["precision"], c.try_cast("timestamp")).cast("string")
    if name == "null_as":
        return F.coalesce(c, F.lit(str(arg["value"]).lower() if isinstance(arg["value"], bool) else str(arg["value"])))
    if name == "strip_non_digits":
        return F.regexp_replace(c, "[^0-9]", "")
    if name in ("unicode_nfc", "ascii_fold"):
        form = "NFC" if name == "unicode_nfc" else "NFKD"

        @F.pandas_udf("string")
        def fold(s: pd.Series) -> pd.Series:
            plain = s.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")
            return plain if form == "NFC" else plain.map(lambda v: v.encode("ascii", "ignore").decode(), na_action="ignore")

        return fold(c)
    raise ExpressionError(f"unknown normaliser {name!r}")


def numeric_text(c: Column) -> Column:
    """A number as text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def canonical(c: Column, kind: str | None) -> Column:
    """A value as the text by which it is compared and resolved."""
    kind = (kind or "string").lower()
    text = c.cast("string")
    if kind in ("numeric", "integer", "decimal", "int", "bigint"):
        number = text.try_cast("decimal(38,18)")
        # most numbers are integers, which are written as they are
        return F.when(text.rlike("^(?:0|-?[1-9][0-9]{0,17})$"), text).when(number.isNotNull(), numeric_text(number)).otherwise(text)
    if kind in ("boolean", "bool"):
        flag = text.try_cast("boolean")
        return F.coalesce(flag.cast("string"), text)
    if kind in ("jsonb", "json") or kind.endswith("[]"):
        return F.coalesce(F.to_json(F.try_parse_json(text)), text)
    return text


def strict_cast(c: Column, kind: str) -> Column:
    """``cast:`` of a field; a value that doesn't fit becomes NULL."""
    text = c.cast("string")
    if kind == "boolean":
        return F.when(text.isin("true", "false"), text)
    if kind == "string":
        return text
    if kind == "integer":
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("decimal(38,0)").cast("string"))
    if kind == "numeric":
        return F.when(text.rlike(r"^[+-]?[0-9]+([.][0-9]+)?$"), numeric_text(text.try_cast("decimal(38,18)")))
    if kind == "date":
        return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date").cast("string"))
    if kind == "timestamp":
        good = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?$")
        return F.when(good, F.date_format(text.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    raise ExpressionError(f"unknown cast {kind!r}")


def mapped_value(c: Column, table: dict, fallback: str = "passthrough") -> Column:
    """``value_map:`` lookup; NULL passes through."""
    pairs = [F.lit(str(x)) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c.cast("string")) if pairs else F.lit(None).cast("string")
    return F.when(c.isNull(), None).otherwise(F.coalesce(found, c.cast("string")) if fallback == "passthrough" else found)


def names_in(text: str) -> list[str]:
    """Column names that a scalar expression reads."""
    toks = tokens(text)
    out = []
    for i, (kind, t) in enumerate(toks):
        after = toks[i + 1][1] if i + 1 < len(toks) else ""
        before = toks[i - 1][1] if i else ""
        if kind == "ident" and after != "(" and before != "::" and t.lower() not in _WORDS:
            out.append(t[1:-1] if t.startswith('"') else t)
    return list(dict.fromkeys(out))


_WORDS = {"and", "or", "not", "is", "null", "true", "false", "in", "like", "ilike", "between", "case", "when", "then", "else", "end", "distinct", "from", "as", "interval", "date", "timestamp", "current_timestamp", "current_date"}
