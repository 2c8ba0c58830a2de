"""The golden record: one aggregation per target, no subquery per field."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions import expressions as X
from goldweave.operators.forward import NULL_VALUE
from goldweave.plans.model import Document, DocumentError, Field, Target


def order(strategy: str, name: str) -> Column:
    """Best first: priority or recency, then declaration order, then the row's key."""
    if strategy == "last_modified":
        first = [F.col(f"t_{name}").isNull(), -F.col(f"t_{name}")]
    else:
        first = [F.col(f"p_{name}").isNull(), F.col(f"p_{name}")]
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*first, F.col("__decl"), F.col("__pk")])])


def without_echoes(doc: Document, target: Target, rows: DataFrame) -> DataFrame:
    """``x_f``: is a value only the echo of another under f's ``normalize``?

    A value from a mapping that normalises loses to a value from one that
    doesn't, however new it is, if both have the same form under its own
    ``normalize``.
    """
    for name in target.fields:
        specs: dict[str, tuple[object, list[str]]] = {}
        for m in doc.into(target.name):
            f = m.field_of(name)
            if f is not None and f.normalize is not None:
                specs.setdefault(repr(f.normalize), (f.normalize, []))[1].append(m.name)
        for k, (spec, mappings) in enumerate(specs.values()):
            rows = rows.withColumn(f"n_{name}", X.normalized(f"v_{name}", spec))
            plain = rows.where(~F.col(f"h_{name}") & F.col(f"n_{name}").isNotNull()).select(F.col("__id").alias("__i"), F.col(f"n_{name}").alias("__n")).distinct().withColumn("__plain", F.lit(True))
            rows = rows.join(plain, (F.col("__id") == F.col("__i")) & (F.col(f"n_{name}") == F.col("__n")), "left")
            echo = F.col("__m").isin(mappings) & F.col("__plain").isNotNull()
            rows = rows.withColumn(f"x_{name}", F.col(f"x_{name}") | echo if k else echo).drop(f"n_{name}", "__i", "__n", "__plain")
    return rows


def with_authority(doc: Document, target: Target, rows: DataFrame, link: str | None) -> DataFrame:
    """Of the sources that feed the elements of one parent, only the best one's rows."""
    if not target.elements or link is None:
        return rows
    parent = F.coalesce(f"e_{link}", f"v_{link}")
    prio = F.coalesce(*[F.when(F.col("__m") == m.name, F.lit(m.priority)) for m in doc.into(target.name)], F.lit(None).cast("int"))
    stamp = F.greatest(F.lit(None).cast("bigint"), *[F.col(f"t_{f}") for f in target.fields])
    first = [stamp.isNull(), -stamp] if target.elements == "last_modified" else [prio.isNull(), prio]
    order_ = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*first, F.col("__decl"), F.col("__pk")])])
    rows = rows.withColumn("__link", parent)
    best = rows.where("__link is not null").groupBy(F.col("__link").alias("__l")).agg(F.min_by("__m", order_).alias("__best"))
    rows = rows.join(best, F.col("__link") == F.col("__l"), "left")
    return rows.where(F.col("__link").isNull() | (F.col("__m") == F.col("__best"))).drop("__link", "__l", "__best")


def golden(target: Target, rows: DataFrame, references: set[str], null_wins: set[str] = frozenset(), positions: tuple[str, ...] = ()) -> DataFrame:
    """``__id``, and for each field ``v_f`` and, for references, ``e_f``: the entity it leads to; ``at_m``: its first place in the arrays of mapping m."""
    aggs: list[Column] = []
    groups: dict[str, list[Field]] = {}
    for f in target.fields.values():
        if f.group:
            groups.setdefault(f.group, []).append(f)
        elif not is_enriched(f):
            aggs.append(_resolved(f, f.name in references, f"x_{f.name}" in rows.columns).alias(f"r_{f.name}"))
    for name, fields in groups.items():
        values = F.struct(*[F.col(f"v_{f.name}").alias(f.name) for f in fields])
        some = F.coalesce(*[F.col(f"v_{f.name}") for f in fields]).isNotNull()
        none = F.lit(None).cast("bigint")
        if fields[0].strategy == "last_modified":
            key = F.greatest(none, *[F.when(F.col(f"v_{f.name}").isNotNull(), F.col(f"t_{f.name}")) for f in fields])
            key = F.struct(key.isNull().alias("a"), (-key).alias("b"), "__decl", "__pk")
        else:
            key = F.least(none.cast("int"), *[F.col(f"p_{f.name}") for f in fields])
            key = F.struct(key.isNull().alias("a"), key.alias("b"), "__decl", "__pk")
        aggs.append(F.min_by(F.when(some, values), F.when(some, key)).alias(f"g_{name}"))
    aggs += [F.min(F.when(F.col("__m") == m, F.col("__pos"))).alias(f"at_{m}") for m in positions]
    out = rows.groupBy("__id").agg(*aggs) if aggs else rows.select("__id").distinct()
    columns = [F.col("__id"), *[F.col(f"at_{m}") for m in positions]]
    for f in target.fields.values():
        if is_enriched(f):
            continue
        value = F.col(f"g_{f.group}")[f.name] if f.group else F.col(f"r_{f.name}")["v"] if f.strategy in ("coalesce", "last_modified", "identity") else F.col(f"r_{f.name}")
        if f.name in null_wins:
            value = F.nullif(value, F.lit(NULL_VALUE))
        if f.default is not None:
            value = F.coalesce(value, X.canonical(F.lit(_text(f.default)), f.type))
        columns.append(value.alias(f"v_{f.name}"))
        if f.name in references:
            columns.append((F.col(f"r_{f.name}")["e"] if not f.group and f.strategy in ("coalesce", "last_modified", "identity") else F.lit(None).cast("string")).alias(f"e_{f.name}"))
    out = out.select(*columns)
    for f in target.fields.values():
        if f.default_expression:
            names = {n: F.col(f"v_{n}") for n in X.names_in(f.default_expression) if n in target.fields}
            computed = out.withColumns(names).withColumn("__d", X.expression(f.default_expression).cast("string"))
            out = computed.withColumn(f"v_{f.name}", F.coalesce(f"v_{f.name}", X.canonical(F.col("__d"), f.type))).drop("__d", *names)
    return out


def _resolved(f: Field, reference: bool, echo: bool) -> Column:
    value = F.col(f"v_{f.name}")
    good = value.isNotNull() & ~F.col(f"x_{f.name}") if echo else value.isNotNull()
    pair = F.struct(value.alias("v"), (F.col(f"e_{f.name}") if reference else F.lit(None).cast("string")).alias("e"))
    if f.strategy in ("coalesce", "last_modified"):
        return F.min_by(F.when(good, pair), F.when(good, order(f.strategy, f.name)))
    if f.strategy == "identity":
        return F.min(F.when(good, pair))
    if f.strategy in ("collect", "multi_value") and f.element:
        held = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.from_json(value, "array<string>")))))
        return F.when(F.size(held) > 0, F.to_json(held))
    if f.strategy in ("collect", "multi_value"):
        held = F.array_sort(F.collect_set(value))
        return F.when(F.size(held) > 0, F.to_json(held))
    if f.strategy in ("bool_or", "any_true"):
        return F.bool_or(value.try_cast("boolean")).cast("string")
    if f.strategy == "all_true":
        return F.bool_and(value.try_cast("boolean")).cast("string")
    sql = X.to_spark(f.expression)
    for n in sorted(X.names_in(f.expression), key=len, reverse=True):
        sql = _renamed(sql, n)
    return X.canonical(F.expr(sql).cast("string"), f.type)


def _renamed(sql: str, name: str) -> str:
    import re

    return re.sub(rf"(?<![\w'.`]){re.escape(name)}(?![\w'(])", f"v_{name}", sql)


def _is_query(text: str | None) -> bool:
    return bool(text) and any(k == "ident" and t.lower() == "select" for k, t in X.tokens(text))


def _dotted(text: str) -> set[str]:
    """The names before a dot in an expression."""
    toks = X.tokens(text)
    return {t for i, (k, t) in enumerate(toks) if k == "ident" and toks[i + 1 : i + 2] and toks[i + 1][1] == "."}


def is_enriched(f: Field) -> bool:
    """Does a field take its value from other targets: by a query, by ``from`` and ``match``, or by a dotted name?"""
    return f.strategy == "expression" and (f.from_ is not None or _is_query(f.expression) or bool(_dotted(f.expression)))


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _outer(text: str, name: str) -> str:
    """``name.`` as the outer row, unless a subquery reads that target without an alias."""
    toks = X.tokens(text)
    words = [t.lower() for _, t in toks]
    for i, w in enumerate(words):
        if w in ("from", "join") and words[i + 1] == name and (i + 2 >= len(words) or toks[i + 2][0] != "ident" or words[i + 2] in ("where", "on", "group", "order", "join")):
            return text
    return " ".join("outer_row" if w == name and words[i + 1 : i + 2] == ["."] else t for i, (w, (_, t)) in enumerate(zip(words, toks, strict=True)))


def enriched(doc: Document, target: Target, resolved: Callable[[str], DataFrame], refers: Callable[[str, str], str | None]) -> DataFrame:
    """The golden record with the fields that other resolved targets give.

    ``resolved`` gives a target's other fields, ``refers(target, field)`` the
    target that a field refers to.
    """
    out = resolved(target.name)
    queries = []
    for f in target.fields.values():
        if not is_enriched(f):
            continue
        if f.from_ is not None:
            out = _matched(f, out, resolved(f.from_))
        elif _is_query(f.expression):
            queries.append(f)
        else:
            out = _followed(doc, target, f, out, resolved, refers)
    return _queried(doc, target, queries, out, resolved) if queries else out


def _matched(f: Field, out: DataFrame, remote: DataFrame) -> DataFrame:
    """An aggregate over the entities of another target whose fields equal this one's; over none, what it gives for no rows."""
    names = [c[2:] for c in remote.columns if c.startswith("v_")]
    plain = remote.select(*[F.col(f"v_{n}").alias(n) for n in names])
    value = F.expr(X.to_spark(f.expression)).cast("string")
    keys = {r: f"__m_{i}" for i, r in enumerate(f.match)}
    by_key = plain.groupBy(*[F.col(r).alias(k) for r, k in keys.items()]).agg(value.alias("__value"), F.lit(True).alias("__some"))
    nothing = plain.where("false").agg(value.alias("v")).first()["v"]
    on = reduce(lambda a, b: a & b, [F.col(f"v_{f.match[r]}") == F.col(k) for r, k in keys.items()])
    found = F.when(F.col("__some"), F.col("__value")).otherwise(F.lit(nothing))
    return out.join(by_key, on, "left").withColumn(f"v_{f.name}", X.canonical(found, f.type)).drop("__value", "__some", *keys.values())


def _followed(doc: Document, target: Target, f: Field, out: DataFrame, resolved: Callable[[str], DataFrame], refers: Callable[[str, str], str | None]) -> DataFrame:
    """An expression over ``other.field``: of the entities of ``other`` that refer to this one."""
    (name, *more) = sorted(_dotted(f.expression))
    if more or name not in doc.targets:
        raise DocumentError([(f"/targets/{target.name}/fields/{f.name}/expression", f"{', '.join([name, *more])}: a dotted name leads to one other target")])
    link = next((x for x in doc.targets[name].fields if refers(name, x) == target.name), None)
    if link is None:
        raise DocumentError([(f"/targets/{target.name}/fields/{f.name}/expression", f"no field of {name} refers to {target.name}")])
    toks, text, local = X.tokens(f.expression), [], []
    i = 0
    while i < len(toks):
        if toks[i][1] == name and toks[i + 1 : i + 2] and toks[i + 1][1] == ".":
            text.append(f"__far_{toks[i + 2][1]}")
            i += 3
            continue
        if toks[i][0] == "ident" and toks[i][1] in target.fields and toks[i + 1 : i + 2] != [("op", "(")]:
            local.append(toks[i][1])
            text.append(f"__near_{toks[i][1]}")
        else:
            text.append(toks[i][1])
        i += 1
    far = resolved(name)
    far = far.select(F.col(f"e_{link}").alias("__to"), *[F.col(c).alias(f"__far_{c[2:]}") for c in far.columns if c.startswith("v_")])
    near = out.select("__id", *[F.col(f"v_{n}").alias(f"__near_{n}") for n in dict.fromkeys(local)])
    value = X.canonical(F.expr(X.to_spark(" ".join(text))).cast("string"), f.type)
    keys = ["__id", *[f"__near_{n}" for n in dict.fromkeys(local)]]
    return out.join(near.join(far, F.col("__id") == F.col("__to"), "left").groupBy(*keys).agg(value.alias(f"v_{f.name}")).select("__id", f"v_{f.name}"), "__id", "left")


def _queried(doc: Document, target: Target, fields: list[Field], out: DataFrame, resolved: Callable[[str], DataFrame]) -> DataFrame:
    spark = out.sparkSession
    words = {t for f in fields for _, t in X.tokens(f.expression)}
    for name in doc.targets:
        if name in words or name == target.name:
            df = out if name == target.name else resolved(name)
            df.select("__id", *[F.col(c).alias(c[2:]) for c in df.columns if c.startswith("v_")]).createOrReplaceTempView(name)
    # the outer row has a name of its own: a column of an inner table may be called as the target is
    picked = ", ".join(f"({X.to_spark(_outer(f.expression, target.name))}) AS `{f.name}`" for f in fields)
    extra = spark.sql(f"SELECT outer_row.__id AS __id, {picked} FROM `{target.name}` AS outer_row")
    extra = extra.select("__id", *[X.canonical(F.col(f.name), f.type).alias(f"v_{f.name}") for f in fields])
    return out.join(extra, "__id", "left")
