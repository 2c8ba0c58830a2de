"""From source rows to contributions: one uniform frame per mapping.

Columns of a contribution: ``__m`` mapping, ``__decl`` its order, ``__pk`` the
row's key as text, ``__ppk`` and ``__pos`` for array elements, ``__row`` its
display id, ``__soft`` and ``__ghost`` flags, ``__cluster`` a fed-back cluster
id, ``__own_m`` the row's own values by source column, a struct for each mapping
m; and for each target field
f ``v_f`` value, ``p_f`` priority, ``t_f`` timestamp in microseconds, and
``h_f``/``n_f`` where a mapping declares ``normalize`` for f.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from goldweave.functions import expressions as X
from goldweave.functions.jsonpath import parse_path, read_path
from goldweave.plans.model import Document, DocumentError, FieldMap, Mapping
from goldweave.sources.registry import as_text, text_of

ELEMENTS = "array<map<string,string>>"
#: Stands for an explicit NULL of a line with ``null_wins`` until the field is resolved.
NULL_VALUE = "\0null"


def from_array_text(text: Column, kind: str, strict: bool) -> Column:
    """A JSON array as an array of ``kind``; NULL for any other text or, if ``strict``, an error."""
    array = F.from_json(text, kind)
    if not strict:
        return array
    wrong = F.raise_error(F.concat(F.lit("not a JSON array: "), F.left(text, F.lit(80))))
    return F.when(text.isNotNull() & (~text.rlike(r"^\s*\[") | array.isNull()), wrong).otherwise(array)


class Scope:
    """Resolves the names that a mapping may use against its rows.

    Arrays of structs are exploded as they are; only text columns are parsed as
    JSON.  With ``strict`` a text that isn't a JSON array is an error.
    """

    def __init__(self, doc: Document, sources: dict[str, DataFrame], strict: bool = False):
        self.doc, self.sources, self.strict = doc, sources, strict

    def kinds(self, m: Mapping) -> dict[str, T.DataType] | None:
        """Types of the columns of a mapping's rows, or of the fields of its elements; None where elements come from JSON text."""
        if m.embedded:
            return self.kinds(self.doc.mappings[m.parent])
        if not m.parent:
            return {f.name: f.dataType for f in self.sources[m.source].schema}
        held = self.kinds(self.doc.mappings[m.parent])
        for step in m.array:
            kind = held.get(step) if held else None
            inner = kind.elementType if isinstance(kind, T.ArrayType) else None
            held = {f.name: f.dataType for f in inner} if isinstance(inner, T.StructType) else None
        return held

    def array_kind(self, m: Mapping) -> T.ArrayType | None:
        """Type of the native array that holds a mapping's elements; None where it is JSON text."""
        kind = (self.kinds(self.doc.mappings[m.parent]) or {}).get(m.array[0])
        return kind if isinstance(kind, T.ArrayType) else None

    def native(self, m: Mapping, name: str, at=F.col) -> Column:
        """A column or field of a mapping's own row as it is."""
        if m.embedded:
            return self.native(self.doc.mappings[m.parent], name, at)
        return at("__el" if m.array else "__raw")[name]

    def value(self, m: Mapping, name: str, at=F.col, inherit: bool = False) -> Column:
        """The text of ``name``: an alias, an element's key, or a source column; ``inherit`` looks further up for what an element lacks."""
        if m.embedded and name not in m.parent_fields:
            return self.value(self.doc.mappings[m.parent], name, at, inherit)
        if not m.parent:
            kind = self.kinds(m).get(name)
            return F.lit(None).cast("string") if kind is None else text_of(at("__raw")[name], kind)
        up = (lambda n: at("__up")[n]) if m.array else at
        if name in m.parent_fields:
            spec = m.parent_fields[name]
            owner = self.doc.mappings[m.parent]
            if isinstance(spec, str):
                return self.value(owner, spec, up, True)
            level = m
            while level.array[:1] != tuple(str(spec.get("path", "")).split(".")[:1]) and level.parent:
                owner_of = self.doc.mappings[level.parent]
                if level is not m:
                    up = (lambda u: lambda n: u("__up")[n])(up) if level.array else up
                level = owner_of
            if level is not m:
                up = (lambda u: lambda n: u("__up")[n])(up) if level.array else up
            owner = self.doc.mappings[level.parent] if level.parent else level
            return self.value(owner, spec["field"], up, True)
        element, kinds = at("__el"), self.kinds(m)
        above = lambda: self.value(self.doc.mappings[m.parent], name, up, True)
        if kinds is not None:
            own = text_of(element[name], kinds[name]) if name in kinds else F.lit(None).cast("string")
            return F.coalesce(own, above()) if inherit else own
        own = F.try_element_at(element, F.lit(name))
        return F.when(F.map_contains_key(element, F.lit(name)), own).otherwise(above()) if inherit else own

    def rows(self, m: Mapping) -> DataFrame:
        """The mapping's logical rows."""
        if m.embedded:
            return self.rows(self.doc.mappings[m.parent])
        if not m.parent:
            df = self.sources[m.source]
            missing = [c for c in self.doc.source_of(m).primary_key if c not in df.columns]
            if missing:
                raise DocumentError(f"source {m.source}: no column {', '.join(missing)}")
            raw = F.struct(*[F.col(f"`{c}`") for c in df.columns])
            pk = self.doc.source_of(m).primary_key
            key = as_text(df, pk[0]) if len(pk) == 1 else F.to_json(F.struct(*[as_text(df, c).alias(c) for c in sorted(pk)]))
            rows = df.select(raw.alias("__raw"), key.alias("__pk"), F.lit(None).cast("string").alias("__ppk"), F.lit(None).cast("int").alias("__pos"))
            return self.filtered(m, rows)
        parent = self.doc.mappings[m.parent]
        rows = self.rows(parent)
        scalar = any(f.scalar for f in m.fields)
        held, owner = self.kinds(parent), parent
        while owner.embedded:
            owner = self.doc.mappings[owner.parent]
        for depth, step in enumerate(m.array):
            kind = held.get(step) if held else None
            bare = scalar and depth == len(m.array) - 1
            if isinstance(kind, T.ArrayType):
                items, inner = self.native(owner, step) if depth == 0 else F.col("__el")[step], kind.elementType
            else:
                text = self.value(parent, step) if depth == 0 else F.try_element_at(F.col("__el"), F.lit(step)) if held is None else text_of(F.col("__el")[step], kind) if kind else F.lit(None).cast("string")
                items, inner = from_array_text(text, "array<string>" if bare else ELEMENTS, self.strict), None
            # an element carries the row that it lies in, without the array
            whole = F.struct(*[_without(c, rows.schema[c].dataType, step).alias(c) for c in rows.columns]) if depth == 0 else F.col("__up")
            place = F.concat_ws(":", "__pk", "pos")
            rows = rows.select(whole.alias("__up"), "__pk", *([F.col("__ppk")] if depth else []), F.posexplode(items).alias("pos", "x"))
            x = F.col("x")
            if bare:
                element = F.create_map(F.lit(""), x if inner is None else text_of(x, inner))
            elif inner is None or isinstance(inner, T.StructType):
                element = x
            else:  # an array of texts or of maps
                element = x.cast("map<string,string>") if isinstance(inner, T.MapType) else F.from_json(text_of(x, inner), "map<string,string>")
            held = {f.name: f.dataType for f in inner} if isinstance(inner, T.StructType) and not bare else None
            rows = rows.select("__up", element.alias("__el"), place.alias("__pk"), (F.col("__ppk") if depth else F.col("__pk")).alias("__ppk"), F.col("pos").alias("__pos"))
        return self.filtered(m, rows)

    def filtered(self, m: Mapping, rows: DataFrame) -> DataFrame:
        if m.filter is None:
            return rows
        return self.with_names(m, rows, m.filter).where(X.predicate(m.filter, F.col)).select(*rows.columns)

    def with_names(self, m: Mapping, rows: DataFrame, spec) -> DataFrame:
        """``rows`` with the columns that an expression names."""
        spec = X.pick(spec)
        names = X.predicate_names(spec)
        return rows.withColumns({n: self.value(m, n) for n in names if n not in rows.columns}) if names else rows

    def forward(self, m: Mapping) -> DataFrame:
        target = self.doc.targets[m.target]
        v2 = self.doc.version == "2.0"
        rows = self.rows(m)
        keep = rows.columns
        lines = {f: m.field_of(f) for f in target.fields}
        neighbours = [f for f in m.fields if f.order_prev or f.order_next]
        if neighbours:
            own = [f for g in target.identity for f in g if lines[f] and lines[f].source not in m.parent_fields]
            texts = [X.canonical(self.value(m, lines[f].source) if lines[f].source else F.try_element_at(F.col("__el"), F.lit("")), target.fields[f].type) for f in own]
            ident = texts[0] if len(texts) == 1 else F.to_json(F.struct(*[t.alias(f) for t, f in zip(texts, own, strict=True)]))
            beside = Window.partitionBy("__ppk").orderBy("__pos")
            rows = rows.withColumn("__ident", ident).withColumn("__prev", F.lag("__ident").over(beside)).withColumn("__next", F.lead("__ident").over(beside))
        for line in m.fields:
            if line.expression is not None and line.forward:
                rows = self.with_names(m, rows, line.expression)
        out = {"__m": F.lit(m.name), "__decl": F.lit(m.order), "__pk": F.col("__pk"), "__ppk": F.col("__ppk"), "__pos": F.col("__pos"), "__row": F.concat_ws(":", F.lit(m.source if v2 else m.name), "__pk"), "__ghost": F.lit(False)}
        flag, soft_target = self.soft(m), (m.soft_delete or {}).get("target")
        out["__soft"] = flag if soft_target is None else F.lit(False)
        out["__cluster"] = self.value(m, m.cluster_field) if m.cluster_field else F.lit(None).cast("string")
        identity = {f for g in target.identity for f in g}
        for name, spec in target.fields.items():
            line = lines[name]
            value = self.source_value(m, line) if line else F.lit(None).cast("string")
            value = X.canonical(value, spec.type)
            if line is not None and line.null_wins:
                value = F.coalesce(value, F.lit(NULL_VALUE))
            if soft_target == name:
                value = flag.cast("string")
            elif soft_target and name not in identity:
                value = F.when(~flag, value)
            out[f"v_{name}"] = value
            prio = None if line is None else line.priority if line.priority is not None else m.priority
            out[f"p_{name}"] = F.lit(prio).cast("int")
            out[f"t_{name}"] = self.timestamp(m, line)
            out[f"h_{name}"] = F.lit(bool(line and line.normalize is not None))
        out[f"__own_{m.name}"] = self.own(m)
        base = rows.withColumns({f"__o{i}": c for i, c in enumerate(out.values())})
        return base.select(*[F.col(f"__o{i}").alias(n) for i, n in enumerate(out)])

    def source_value(self, m: Mapping, line: FieldMap) -> Column:
        if line.order:
            return F.lpad(F.col("__pos").cast("string"), 10, "0")
        if line.order_prev or line.order_next:
            return F.col("__prev" if line.order_prev else "__next")
        if line.scalar:
            return F.try_element_at(F.col("__el"), F.lit(""))
        if line.expression is not None:
            return F.expr(X.to_spark(X.pick(line.expression))).cast("string")
        if line.source_path is not None:
            steps = parse_path(line.source_path)
            return read_path(self.value(m, steps[0]), steps[1:])
        if line.sources:
            return F.concat_ws(line.join["sep"], *[F.coalesce(self.value(m, c), F.lit("")) for c in line.sources])
        if line.source is None:
            return F.lit(None).cast("string")
        value = self.value(m, line.source)
        if line.cast is not None:
            value = X.strict_cast(value, line.cast)
        if line.value_map is not None:
            value = X.mapped_value(value, line.value_map, line.value_map_fallback)
        return value

    def timestamp(self, m: Mapping, line: FieldMap | None) -> Column:
        """Microseconds; of a range {min, max} the later."""
        spec = None if line is None else line.last_modified if line.last_modified is not None else m.last_modified
        if spec is None:
            return F.lit(None).cast("bigint")
        names = [spec] if isinstance(spec, str) else [spec[k] for k in ("min", "max") if k in spec]
        stamps = [F.unix_micros(self.value(m, n, inherit=True).try_cast("timestamp")) for n in names]
        return stamps[0] if len(stamps) == 1 else F.greatest(*stamps)

    def soft(self, m: Mapping) -> Column:
        if not m.soft_delete:
            return F.lit(False)
        value, strategy = self.value(m, m.soft_delete["field"]), m.soft_delete.get("strategy", "timestamp")
        if strategy == "timestamp":
            return value.isNotNull()
        flag = value.try_cast("boolean")
        return F.coalesce(flag, F.lit(True)) if strategy == "deleted_flag" else ~F.coalesce(flag, F.lit(False))

    def columns(self, m: Mapping) -> list[str]:
        """The columns of a mapping's own rows."""
        return list(self.kinds(m) or ())

    def own_names(self, m: Mapping) -> list[str]:
        """The source columns whose own values a mapping's rows keep."""
        names = [f.source for f in m.fields if f.source and f.backward] + [c for f in m.fields for c in f.sources] + [parse_path(f.source_path)[0] for f in m.fields if f.source_path] + list(m.passthrough)
        if not m.parent:
            names += self.doc.source_of(m).primary_key
        if m.include_base:
            names += self.columns(m)
        names += [c.array[0] for c in self.doc.children(m.name) if c.array]
        return list(dict.fromkeys(names))

    def own(self, m: Mapping) -> Column:
        """The row's values by source column: text, or for the elements of children native arrays where they are some."""
        arrays = {c.array[0] for c in self.doc.children(m.name) if c.array and self.array_kind(c) is not None}
        fields = [(self.native(m, n) if n in arrays else self.value(m, n)).alias(n) for n in self.own_names(m)]
        return F.struct(*fields, F.lit(None).cast("string").alias("__"))

    def own_value(self, m: Mapping, name: str) -> Column:
        """A value out of ``__own``; NULL where it doesn't hold the name."""
        return F.col("__own")[name] if name in self.own_names(m) else F.lit(None).cast("string")

    def own_text(self, m: Mapping, name: str) -> Column:
        """The same as text."""
        child = next((c for c in self.doc.children(m.name) if c.array and c.array[0] == name), None)
        kind = self.array_kind(child) if child else None
        return self.own_value(m, name) if kind is None else text_of(self.own_value(m, name), kind)


def _without(name: str, kind: T.DataType, field: str) -> Column:
    """A column of rows, and if it's a struct that holds ``field`` besides others, without it."""
    held = isinstance(kind, T.StructType) and name in ("__raw", "__el") and field in kind.fieldNames() and len(kind.fields) > 1
    return F.col(name).dropFields(f"`{field}`") if held else F.col(name)
