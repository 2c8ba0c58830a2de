"""Dotted JSON paths: reading one, and writing values back without touching the rest."""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"\.?\['((?:[^']|'')*)'\]|\.?\[(\d+)\]|\.?([^.\[\]]+)")
#: Types whose values a JSON document holds without quotes.
TYPED = ("numeric", "integer", "decimal", "int", "bigint", "boolean", "bool", "jsonb", "json")


def parse_path(path: str) -> list[str | int]:
    """Steps of ``a.b[0].['dotted.key']``; the first is the column."""
    steps, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if m is None:
            raise ValueError(f"not a path: {path!r}")
        steps.append(m[1].replace("''", "'") if m[1] is not None else int(m[2]) if m[2] is not None else m[3])
        at = m.end()
    if not steps or not isinstance(steps[0], str):
        raise ValueError(f"a path starts with a column: {path!r}")
    return steps


def read_path(column: Column, steps: list[str | int]) -> Column:
    """The text at ``steps`` (without the column) inside a JSON column; NULL where there is none."""
    where = "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    return F.get_json_object(column, where)


def leaf(value: Column, held: Column, kind: str | None) -> Column:
    """A text as the JSON value that takes the place of ``held``.

    Values of typed fields are JSON values.  Any other stays a number or a
    boolean where it replaces one and reads as one, and is a string elsewhere.
    """
    text, read = value.cast("variant"), F.try_parse_json(value)
    if (kind or "").lower() in TYPED:
        return F.coalesce(read, text)
    class_of = lambda v: F.when(F.schema_of_variant(v) == "BOOLEAN", 1).when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), 2)
    return F.when(class_of(held) == class_of(read), read).otherwise(text)


def write_paths(df: DataFrame, document: Column, leaves: list[tuple[list[str | int], Column, str | None]], out: str) -> DataFrame:
    """``df`` with ``out``: the JSON ``document`` with texts put at paths, (steps, text, type of the field) each.

    A NULL removes nothing: it's written as null where the path exists.
    Containers that are missing are made, and one of another kind is replaced,
    unless nothing is written into it.  What no path names stays as it is.
    """
    numbers = count()
    temporary: list[str] = []

    def put(name: str, value: Column) -> Column:
        nonlocal df
        temporary.append(f"{out}_{name}{next(numbers)}")
        df = df.withColumn(temporary[-1], value)
        return F.col(temporary[-1])

    def node(text: Column, paths: list[tuple[list[str | int], Column, str | None]]) -> tuple[Column, Column]:
        """(new text, is anything written) of the container in ``text``."""
        keyed = isinstance(paths[0][0][0], str)
        empty = F.create_map().cast("map<string,variant>") if keyed else F.array().cast("array<variant>")
        inside = put("in", F.coalesce(F.from_json(text, "map<string,variant>" if keyed else "array<variant>"), empty))
        steps = list(dict.fromkeys(p[0][0] for p in paths if isinstance(p[0][0], str) == keyed))
        entries = []
        for step in steps:
            below = [p for p in paths if p[0][0] == step and len(p[0]) > 1]
            exists = F.map_contains_key(inside, F.lit(step)) if keyed else F.size(inside) > step
            held = F.try_element_at(inside, F.lit(step)) if keyed else F.get(inside, F.lit(step))
            if below:
                new, written = node(put("text", F.to_json(held)), [(s[1:], v, k) for s, v, k in below])
                new = F.try_parse_json(new)
            else:
                _, value, kind = next(p for p in paths if p[0][0] == step)
                new, written = F.coalesce(leaf(value, held, kind), F.parse_json(F.lit("null"))), value.isNotNull() | exists
            entries.append(put("new", F.struct(F.lit(step).alias("step"), F.when(written, new).alias("value"), written.alias("written"))))
        fresh = F.filter(F.array(*entries), lambda e: e["written"])
        some = put("some", F.size(fresh) > 0)
        if keyed:
            kept = F.map_filter(inside, lambda k, _: ~F.exists(fresh, lambda e: e["step"] == k))
            whole = F.map_concat(kept, F.map_from_entries(F.transform(fresh, lambda e: F.struct(e["step"], e["value"]))))
        else:
            last = F.array_max(F.transform(fresh, lambda e: e["step"]))
            longer = F.concat(inside, F.array_repeat(F.parse_json(F.lit("null")), F.greatest(F.lit(0), last + 1 - F.size(inside))))
            whole = F.transform(longer, lambda x, i: F.coalesce(F.get(F.transform(F.filter(fresh, lambda e: e["step"] == i), lambda e: e["value"]), F.lit(0)), x))
        return put("out", F.when(some, F.to_json(whole)).otherwise(text)), some

    new, _ = node(put("text", document.cast("string")), leaves)
    return df.withColumn(out, new).drop(*temporary)
