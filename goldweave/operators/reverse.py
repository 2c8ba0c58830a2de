"""Back to the shape of each source: values, references in its own keys, and nested arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldweave.functions import expressions as X
from goldweave.functions.jsonpath import parse_path, write_paths
from goldweave.operators.forward import ELEMENTS
from goldweave.operators.ordered import linked_positions
from goldweave.plans.model import FieldMap, Mapping
from goldweave.sources.registry import text_of


class Reverse:
    """Builds reverse frames on top of a pipeline's contributions and golden records."""

    def __init__(self, pipe):
        self.pipe, self.doc = pipe, pipe.doc

    def lines(self, m: Mapping) -> list[FieldMap]:
        """The lines that write something: a source column or element key, each once."""
        out, seen = [], set()
        for f in m.fields:
            place = f.source_path or f.source or f.sources or ("\0" if f.scalar else None)
            if place is None or not f.backward or place in seen or f.source in m.parent_fields:
                continue
            if f.target is None and f.reverse_expression is None:
                continue
            seen.add(place)
            out.append(f)
        return out

    def resolved(self, m: Mapping, g: DataFrame) -> DataFrame:
        """A golden frame with ``w_i``, the value of each line as this mapping's source spells it, and ``__pass``."""
        target = self.doc.targets[m.target]
        for i, f in enumerate(self.lines(m)):
            if f.target is not None and f.target in self.pipe.references(m.target):
                g = self.pipe.translated(m, f, g, f"w_{i}")
            else:
                g = g.withColumn(f"w_{i}", F.col(f"v_{f.target}") if f.target is not None else F.lit(None).cast("string"))
        names = {n: F.col(f"v_{n}") for n in target.fields}
        plain = g.withColumns(names)
        for i, f in enumerate(self.lines(m)):
            if f.reverse_expression is not None:
                plain = plain.withColumn(f"w_{i}", F.expr(X.to_spark(X.pick(f.reverse_expression))).cast("string"))
            elif f.value_map is not None or f.reverse_value_map is not None:
                table = f.reverse_value_map or {v: k for k, v in f.value_map.items()}
                plain = plain.withColumn(f"w_{i}", X.mapped_value(F.col(f"w_{i}"), table, f.value_map_fallback))
        kinds = {n: f.hierarchy for n, f in target.fields.items() if f.hierarchy}
        good = X.predicate(X.with_descendants(m.reverse_filter, kinds), F.col) if m.reverse_filter is not None else F.lit(True)
        for f in m.fields:
            if f.reverse_required:
                i = next((i for i, x in enumerate(self.lines(m)) if x is f), None)
                good = good & (F.col(f"w_{i}") if i is not None else F.col(f"v_{f.target}")).isNotNull()
        plain = plain.withColumn("__pass", good)
        if m.gated:
            plain = plain.withColumn("__ask_when", X.predicate(m.confirm_when, F.col) if m.confirm_when is not None else F.lit(False))
        return plain.drop(*names)

    def kind(self, m: Mapping, f: FieldMap) -> str | None:
        if f.target is None:
            return None
        spec = self.doc.targets[m.target].fields[f.target]
        return "jsonb" if spec.strategy in ("collect", "multi_value") else spec.type

    def keep_own(self, m: Mapping, f: FieldMap) -> bool:
        t = self.doc.targets[m.target]
        return t.keep_own and f.target is not None and t.fields[f.target].strategy == "identity"

    # arrays

    def links(self, m: Mapping) -> tuple[list[str], list[tuple[str, str]]]:
        """How elements find their parent: target fields that refer to it, else (element field, parent field) pairs."""
        parent = self.doc.mappings[m.parent]
        refs, equal = [], []
        for f in m.fields:
            if f.source not in m.parent_fields or f.target is None:
                continue
            if self.pipe.referred(m.target, f.target) == parent.target:
                refs.append(f.target)
            spec = m.parent_fields[f.source]
            name = spec if isinstance(spec, str) else spec["field"]
            up = next((x.target for x in parent.fields if x.source == name and x.target), None)
            if up is not None:
                equal.append((f.target, up))
        return refs, equal

    def order(self, m: Mapping) -> list[Column]:
        t = self.doc.targets[m.target]
        keys: list[Column] = []

        def of(name: str, descending: bool = False) -> list[Column]:
            c = F.col(f"v_{name}")
            if t.fields[name].type in ("numeric", "integer"):
                n = c.try_cast("decimal(38,18)")
                return [n.isNull(), -n if descending else n]
            # text: descending order by complemented code points, closed by one above them all, so that a text goes before its own beginnings
            return [c.isNull(), c] if not descending else [c.isNull(), F.concat(F.transform(F.split(c, ""), lambda x: -F.ascii(x)), F.array(F.lit(1)))]

        for s in m.sort:
            keys += of(s["field"], s.get("direction") == "desc")
        for f in m.fields:
            if f.order and not m.sort:
                keys += [F.col(f"v_{f.target}").isNull(), F.col(f"v_{f.target}"), F.col("__at").isNull(), F.col("__at")]
        if self.chained(m):
            keys += [F.col("__chain").isNull(), F.col("__chain")]
        for g in t.identity:
            for name in g:
                keys += of(name)
        return [*keys, F.col("__id")]

    def chained(self, m: Mapping) -> bool:
        """Is a mapping's order that of the resolved neighbours alone?"""
        return any(f.order_prev for f in m.fields) and not any(f.order for f in m.fields) and not m.sort

    def elements(self, m: Mapping) -> DataFrame:
        """(parent, items): each parent entity's elements in this mapping's shape, as an array."""
        g = self.resolved(m, self.pipe.golden(m.target)).where("__pass")
        gone = self.pipe.contributions(m.target, alive=False).where("__soft").select("__id").distinct()
        if any(x.soft_delete for x in self.doc.into(m.target)):
            g = g.join(gone, "__id", "left_anti")
        if f"at_{m.name}" in g.columns:
            g = g.withColumn("__at", F.col(f"at_{m.name}"))
        inner = self.doc.children(m.name)
        for c in inner:
            if c.array:
                g = g.join(self.elements(c).withColumnRenamed("parent", "__id").withColumnRenamed("items", f"a_{c.name}"), "__id", "left")
        refs, equal = self.links(m)
        if refs:
            g = g.withColumn("parent", F.col(f"e_{refs[0]}"))
        elif equal:
            parent = self.doc.mappings[m.parent]
            ids = self.pipe.golden(parent.target).select(F.col("__id").alias("parent"), *[F.col(f"v_{p}").alias(f"up_{i}") for i, (_, p) in enumerate(equal)])
            g = g.join(ids, reduce(lambda a, b: a & b, [F.col(f"v_{c}") == F.col(f"up_{i}") for i, (c, _) in enumerate(equal)]))
        else:
            raise ValueError(f"mapping {m.name}: no parent field links its elements")
        if self.chained(m):
            own = [f for x in self.doc.targets[m.target].identity for f in x if m.field_of(f) is None or m.field_of(f).source not in m.parent_fields]
            neighbour = lambda kind: next(F.col(f"v_{f.target}") for f in m.fields if getattr(f, kind) and f.target)
            g = linked_positions(g, own, neighbour("order_prev"), neighbour("order_next"))
        item = self.item(m)
        keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(self.order(m))])
        lists = g.where("parent is not null").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct(keys.alias("k"), item.alias("x")))).alias("s"))
        return lists.select("parent", F.transform("s", lambda s: s["x"]).alias("items"))

    def item(self, m: Mapping) -> Column:
        lines = self.lines(m)
        if any(f.scalar for f in lines):
            return F.col(f"w_{next(i for i, f in enumerate(lines) if f.scalar)}")
        parts = [X.canonical(F.col(f"w_{i}"), self.kind(m, f)).alias(f.source) for i, f in enumerate(lines)]
        for c in self.doc.children(m.name):
            if c.array:
                parts.append(F.coalesce(F.col(f"a_{c.name}"), F.array().cast(self.type(c))).alias(c.array[0]))
        return F.struct(*parts)

    def type(self, m: Mapping) -> str:
        lines = self.lines(m)
        if any(f.scalar for f in lines):
            return "array<string>"
        parts = [f"`{f.source}`:string" for f in lines] + [f"`{c.array[0]}`:{self.type(c)}" for c in self.doc.children(m.name) if c.array]
        return f"array<struct<{','.join(parts)}>>"

    def typed(self, m: Mapping, items: Column) -> Column:
        """Elements for writing: values of numeric, boolean and JSON fields are JSON values, all others text."""
        lines = self.lines(m)
        inner = [c for c in self.doc.children(m.name) if c.array]
        kinds = [(self.kind(m, f) or "string").lower() for f in lines]
        if any(f.scalar for f in lines) or not inner and not {"numeric", "integer", "boolean", "jsonb"} & set(kinds):
            return items

        def shape(x: Column) -> Column:
            parts = [(F.try_parse_json(x[f.source]) if k in ("numeric", "integer", "boolean", "jsonb") else x[f.source]).alias(f.source) for f, k in zip(lines, kinds, strict=True)]
            return F.struct(*parts, *[self.typed(c, x[c.array[0]]).alias(c.array[0]) for c in inner])

        return F.transform(items, shape)

    def own_elements(self, m: Mapping, text: Column, kind: T.DataType | None = None) -> Column:
        """A source's own array, native (of type ``kind``) or JSON text, in the shape of ``elements``: mapped keys only, values canonical."""
        lines = self.lines(m)
        if isinstance(kind, T.ArrayType):
            return self._own_native(m, text, kind)
        for step in m.array[1:]:
            outer = F.from_json(text, ELEMENTS)
            text = F.to_json(F.flatten(F.transform(outer, lambda o: F.coalesce(F.from_json(F.try_element_at(o, F.lit(step)), ELEMENTS), F.array().cast(ELEMENTS)))))
        if any(f.scalar for f in lines):
            return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))

        def shape(x: Column) -> Column:
            parts = [X.canonical(F.try_element_at(x, F.lit(f.source)), self.kind(m, f)).alias(f.source) for f in lines]
            parts += [self.own_elements(c, F.try_element_at(x, F.lit(c.array[0]))).alias(c.array[0]) for c in self.doc.children(m.name) if c.array]
            return F.struct(*parts)

        return F.coalesce(F.transform(F.from_json(text, ELEMENTS), shape), F.array().cast(self.type(m)))

    def _own_native(self, m: Mapping, items: Column, kind: T.ArrayType) -> Column:
        lines = self.lines(m)
        for step in m.array[1:]:
            inner = {f.name: f.dataType for f in kind.elementType}.get(step) if isinstance(kind.elementType, T.StructType) else None
            if not isinstance(inner, T.ArrayType):
                return F.array().cast(self.type(m))
            items, kind = F.flatten(F.transform(items, lambda o, step=step, inner=inner: F.coalesce(o[step], F.array().cast(inner)))), inner
        if not isinstance(kind.elementType, T.StructType):
            texts = F.transform(items, lambda x: text_of(x, kind.elementType))
            return F.coalesce(texts, F.array().cast("array<string>")) if any(f.scalar for f in lines) else self.own_elements(m, F.to_json(F.transform(texts, F.try_parse_json)))
        held = {f.name: f.dataType for f in kind.elementType}

        def shape(x: Column) -> Column:
            parts = [X.canonical(text_of(x[f.source], held[f.source]) if f.source in held else F.lit(None).cast("string"), self.kind(m, f)).alias(f.source) for f in lines]
            for c in self.doc.children(m.name):
                if c.array:
                    inner = held.get(c.array[0])
                    own = x[c.array[0]] if inner is not None else F.lit(None).cast("string")
                    parts.append(self.own_elements(c, own if isinstance(inner, T.ArrayType) or inner is None else text_of(own, inner), inner).alias(c.array[0]))
            return F.struct(*parts)

        return F.coalesce(F.transform(items, shape), F.array().cast(self.type(m)))

    # frames

    def columns(self, m: Mapping) -> list[str]:
        """Source columns that a mapping's deltas carry, without its key."""
        out = [n for f in self.lines(m) if not f.scalar for n in (f.sources or [parse_path(f.source_path)[0] if f.source_path else f.source])]
        out += [n for c in self.doc.children(m.name) if c.embedded for n in self.columns(c)]
        out += [c.array[0] for c in self.doc.children(m.name) if c.array]
        return list(dict.fromkeys(out))

    def frame(self, m: Mapping) -> DataFrame:
        """Entity by member row: ``__id``, ``__pk`` (NULL: no row), ``__own``, ``__soft``, ``__pass``, ``out`` and ``differs``.

        ``out`` holds the text of every source column to write, ``differs`` is
        whether any of them differs from the row's own.
        """
        lines = self.lines(m)
        g = self.resolved(m, self.pipe.golden(m.target))
        for c in self.doc.children(m.name):
            if c.array:
                g = g.join(self.elements(c).withColumnRenamed("parent", "__id").withColumnRenamed("items", f"a_{c.name}"), "__id", "left")
        members = self.pipe.members(m)
        own_ref = [f for f in lines if f.target in self.pipe.references(m.target)]
        mine = members.select("__id", "__pk", "__own", "__soft", *[F.struct(f"v_{f.target}", f"e_{f.target}", f"k_{f.target}").alias(f"m_{f.target}") for f in {f.target: f for f in own_ref}.values()], *[F.col(f"v_{f.target}").alias(f"i_{f.target}") for f in {f.target: f for f in lines if self.keep_own(m, f)}.values()])
        j = g.join(mine, "__id", "left")
        there = F.col("__pk").isNotNull()
        own = lambda n: self.pipe.scope.own_text(m, n)
        outs: dict[str, Column] = {}
        paths: dict[str, list[tuple[list, Column, str | None]]] = {}
        compared: list[tuple[str, str, object]] = []
        for i, f in enumerate(lines):
            value = F.col(f"w_{i}")
            if self.keep_own(m, f):
                value = F.when(there, F.coalesce(own(f.source) if f.source and f.expression is None and f.cast is None else F.col(f"i_{f.target}"), value)).otherwise(value)
            elif f in own_ref and f.reverse_expression is None and (f.references or f.references_field):
                mine_f = F.col(f"m_{f.target}")
                kept = there & F.coalesce(mine_f[f"k_{f.target}"], F.lit(False)) & (mine_f[f"e_{f.target}"] == F.col(f"e_{f.target}"))
                value = F.when(kept, mine_f[f"v_{f.target}"]).otherwise(value)
            if f.sources:
                # a value with fewer separators leaves the last columns NULL
                buckets = F.split(value, "\\Q" + f.split["sep"] + "\\E", int(f.split.get("limit", len(f.sources)))) if f.split else None
                for k, name in enumerate(f.sources):
                    outs[name] = F.get(buckets, F.lit(k)) if f.split else own(name)
                    compared.append((name, "", None))
            elif f.source_path:
                steps = parse_path(f.source_path)
                paths.setdefault(steps[0], []).append((steps[1:], value, self.kind(m, f)))
            else:
                outs[f.source] = value
                compared.append((f.source, self.kind(m, f) or "", f.normalize))
        for k, (name, held) in enumerate(paths.items()):
            j = write_paths(j, own(name), held, f"__doc_{k}")
            outs[name] = X.canonical(F.col(f"__doc_{k}"), "jsonb")
            compared.append((name, "jsonb", None))
        j = j.withColumns({f"out_{i}": v for i, v in enumerate(outs.values())})
        names = list(outs)
        differs = []
        for name, kind, template in compared:
            i = names.index(name)
            j = j.withColumns({f"l_{i}": X.canonical(F.col(f"out_{i}"), kind), f"r_{i}": X.canonical(own(name), kind)})
            if template is not None:
                j = j.withColumns({f"l_{i}": X.normalized(f"l_{i}", template), f"r_{i}": X.normalized(f"r_{i}", template)})
            differs.append(~F.col(f"l_{i}").eqNullSafe(F.col(f"r_{i}")))
        pairs = [(n, F.col(f"out_{i}")) for i, n in enumerate(names)]
        for c in self.doc.children(m.name):
            if not c.array:
                continue
            items = F.coalesce(F.col(f"a_{c.name}"), F.array().cast(self.type(c)))
            differs.append(~items.eqNullSafe(self.own_elements(c, self.pipe.scope.own_value(m, c.array[0]), self.pipe.scope.array_kind(c))))
            whole = self.typed(c, items)
            for step in reversed(c.array[1:]):
                whole = F.array(F.struct(whole.alias(step)))
            pairs.append((c.array[0], F.to_json(whole, {"ignoreNullFields": "false"})))
        out = F.create_map(*[x for n, v in pairs for x in (F.lit(n), v)]) if pairs else F.create_map(F.lit(""), F.lit(None).cast("string"))
        ask = self.confirmations(m, [names.index(n) for f in lines if f.confirm for n in (f.sources or [parse_path(f.source_path)[0] if f.source_path else f.source])])
        j = j.select("__id", "__pk", "__own", "__soft", "__pass", out.alias("out"), (reduce(lambda a, b: a | b, differs) if differs else F.lit(False)).alias("differs"), *ask)
        for c in self.doc.children(m.name):
            if c.embedded and self.lines(c):
                k = self.frame(c).where("__pk is not null").select("__pk", F.col("out").alias("c_out"), F.col("differs").alias("c_differs"))
                j = j.join(k, "__pk", "left")
                names_c = self.columns(c)
                merged = F.map_concat(F.map_filter("out", lambda k, _: ~k.isin(names_c)), F.coalesce("c_out", F.create_map(*[x for n in names_c for x in (F.lit(n), F.lit(None).cast("string"))])))
                j = j.withColumn("out", merged).withColumn("differs", F.col("differs") | F.coalesce("c_differs", F.lit(False))).drop("c_out", "c_differs")
        return j

    def confirmations(self, m: Mapping, fields: list[int]) -> list[Column]:
        """``__ask_when`` and ``__ask_field``, if a mapping has gates: the entity's rule, and whether a gated column changes."""
        if not m.gated:
            return []
        changed = [~F.col(f"l_{i}").eqNullSafe(F.col(f"r_{i}")) for i in fields]
        return [F.col("__ask_when"), (reduce(lambda a, b: a | b, changed) if changed else F.lit(False)).alias("__ask_field")]
