"""From a document and its sources to golden records and deltas.

Stages are lazy DataFrames, built on first use and shared.  Two things run jobs
while a plan is built: a clustering by several keys, and the deltas, which read
a target's clustered contributions twice (for the golden record and for the
members) and so write them down once.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.operators import resolve
from goldweave.operators.delta import Deltas, Shape, classified, deltas
from goldweave.operators.forward import Scope
from goldweave.operators.identity import cluster
from goldweave.operators.intermediate import materialise
from goldweave.operators.reverse import Reverse
from goldweave.plans.model import Document, DocumentError, FieldMap, Mapping, Target

#: Spark types of the elements of array fields; any other is text.
_ELEMENTS = {"numeric": "decimal(38,18)", "decimal": "decimal(38,18)", "integer": "bigint", "int": "bigint", "bigint": "bigint", "boolean": "boolean", "bool": "boolean"}


class NotUnique(RuntimeError):
    """A result holds a key twice."""


class Pipeline:
    """``sources``: frames by source name.  ``state``: frames named ``_written_<mapping>`` and ``_cluster_members_<mapping>``.

    A missing source is empty; ``persist=True`` caches what several mappings of
    a target share, instead of writing it down.  ``strict`` refuses what is
    otherwise read leniently: a text that isn't a JSON array where one belongs,
    and in version 2 a target with several identity groups.
    """

    def __init__(self, doc: Document, sources: dict[str, DataFrame], state: dict[str, DataFrame] | None = None, persist: bool = False, strict: bool = False):
        from goldweave.sources.registry import columns_used, from_rows

        if not sources:
            raise DocumentError("no source is given")
        self.spark = next(iter(sources.values())).sparkSession
        self.doc, self.state, self.keep = doc, state or {}, persist
        full = {}
        for name in doc.sources:
            df = sources.get(name)
            if df is None or not df.columns:
                df = from_rows(self.spark, [], columns_used(doc, name))
            else:
                self._require(name, df.columns)
            full[name] = df
        if strict and doc.version == "2.0":
            several = [(f"/targets/{t.name}/identity", "several identity groups") for t in doc.targets.values() if len(t.identity) > 1]
            if several:
                raise DocumentError(several)
        self.sources = full
        self.scope = Scope(doc, full, strict)
        self.reverse = Reverse(self)
        self.sharing = False
        self._shared = ("identified", "contributions", "golden", "lookup", "frame", "_linked", "_resolved")
        for name in ("forward", *self._shared):
            setattr(self, name, cache(getattr(self, name)))
        self._open: list[str] = []

    def _require(self, source: str, columns: list[str]) -> None:
        """Every column that a mapping reads must be there; only written ones may be missing."""
        lost = []
        for m in self.doc.mappings.values():
            if m.source != source or m.parent:
                continue
            stamps = [f.last_modified for f in m.fields] + [m.last_modified]
            read = [f.source for f in m.fields if f.direction != "reverse_only" and f.expression is None] + [c for f in m.fields for c in f.sources] + [t for t in stamps if isinstance(t, str)]
            read += list(self.doc.sources[source].primary_key) + [c.array[0] for c in self.doc.children(m.name) if c.array] + [(m.soft_delete or {}).get("field")]
            lost += [(f"/mappings/{m.name}", f"source {source} has no column {c!r}") for c in dict.fromkeys(read) if c and c not in columns]
        if lost:
            raise DocumentError(lost)

    # references

    def referred(self, target: str, field: str) -> str | None:
        """The target that a field refers to."""
        spec = self.doc.targets[target].fields[field]
        if spec.references:
            return spec.references
        for m in self.doc.into(target):
            f = m.field_of(field)
            if f is not None and f.references:
                return self.doc.mappings[f.references].target if f.references in self.doc.mappings else f.references
        return None

    def references(self, target: str) -> set[str]:
        return {f for f in self.doc.targets[target].fields if self.referred(target, f)}

    def _space(self, m: Mapping, f: FieldMap) -> tuple[str, str | None, str | None]:
        """(target, mapping or None for any, field) in which a line's values are looked up."""
        target = self.referred(m.target, f.target)
        return target, f.references if f.references in self.doc.mappings else None, f.references_field

    def _field_named(self, mapping: Mapping, name: str) -> str:
        """A target field by its own name or by the source column that feeds it."""
        if name in self.doc.targets[mapping.target].fields:
            return name
        return next(f.target for f in mapping.fields if f.source == name)

    def lookup(self, target: str, mapping: str | None, field: str | None) -> DataFrame:
        """(k, e, direct): the entity of a key; ``direct`` where k is the row's own key or the named field.

        A key of the row goes before a value of an identity field.
        """
        rows = self.identified(target).where(~F.col("__ghost"))
        rows = rows.where(F.col("__m") == mapping) if mapping else rows
        one = self.doc.mappings[mapping] if mapping else self.doc.into(target)[0]
        if field:
            kinds = [(0, f"v_{self._field_named(one, field)}")]
        else:
            kinds = [(0, "__pk")] + [(1, f"v_{f}") for g in self.doc.targets[target].identity for f in g]
        keys = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(c).alias("k")) for r, c in kinds])).alias("x")
        return rows.select("__id", keys).select("x.k", "x.r", "__id").where("k is not null").groupBy("k").agg(F.min(F.struct("r", "__id")).alias("b")).select("k", F.col("b.__id").alias("e"), (F.col("b.r") == 0).alias("direct"))

    def translated(self, m: Mapping, f: FieldMap, g: DataFrame, out: str) -> DataFrame:
        """``g`` with the key by which this mapping's namespace knows the entity ``e_f``."""
        target, space, field = self._space(m, f)
        if space is None and not f.references and not f.references_field:
            return g.withColumn(out, F.col(f"v_{f.target}"))
        rows = self.identified(target).where(~F.col("__ghost"))
        rows = rows.where(F.col("__m") == space) if space else rows
        key = f"v_{self._field_named(self.doc.mappings[space] if space else self.doc.into(target)[0], field)}" if field else "__pk"
        names = rows.groupBy(F.col("__id").alias("__e")).agg(F.min(key).alias(out))
        return g.join(names, F.col(f"e_{f.target}") == F.col("__e"), "left").drop("__e")

    def _link(self, m: Mapping, df: DataFrame, fields: set[str]) -> DataFrame:
        """``df`` (one mapping's contributions) with ``e_f`` and ``k_f`` for these reference fields."""
        for name in sorted(fields):
            f = m.field_of(name)
            if f is None:
                df = df.withColumn(f"e_{name}", F.lit(None).cast("string")).withColumn(f"k_{name}", F.lit(False))
                continue
            found = self.lookup(*self._space(m, f)).select(F.col("k").alias("__k"), F.col("e").alias(f"e_{name}"), F.col("direct").alias(f"k_{name}"))
            df = df.join(found, F.col(f"v_{name}") == F.col("__k"), "left").drop("__k")
        return df

    # stages

    def forward(self, mapping: str) -> DataFrame:
        return self.scope.forward(self.doc.mappings[mapping])

    def identified(self, target: str) -> DataFrame:
        """All contributions to a target with ``__id``; references inside the identity are compared by entity."""
        t = self.doc.targets[target]
        self._open.append(target)
        try:
            refs = {f for g in t.identity for f in g} & self.references(target)
            # a cycle of identities falls back to the values themselves
            refs = {f for f in refs if self.referred(target, f) not in self._open}
            parts = [self._link(m, self._with_ghosts(m), refs) for m in self.doc.into(target)]
        finally:
            self._open.pop()
        # what depends on the mapping alone isn't exchanged or written with every row
        fixed = self._fixed(t)
        rows = reduce(_union, parts).drop(*fixed)
        out = cluster(self.doc, t, rows, refs, self._edges(target))
        out = out.persist() if self.keep else materialise(out, f"identified_{target}") if self.sharing else out
        return out.withColumns(fixed)

    def _fixed(self, t: Target) -> dict[str, Column]:
        """The columns of contributions that a row's mapping fixes: priorities, flags for ``normalize``, and timestamps that no mapping has."""
        out: dict[str, Column] = {}
        own = lambda m: (F.col("__m") == m.name) & ~F.col("__ghost")
        for name in t.fields:
            lines = [(m, f) for m in self.doc.into(t.name) for f in [m.field_of(name)] if f is not None]
            ranked = [F.when(own(m), F.lit(f.priority if f.priority is not None else m.priority).cast("int")) for m, f in lines]
            out[f"p_{name}"] = F.coalesce(*ranked, F.lit(None).cast("int"))
            out[f"h_{name}"] = reduce(lambda a, b: a | b, [own(m) for m, f in lines if f.normalize is not None], F.lit(False))
            if all(f.last_modified is None and m.last_modified is None for m, f in lines):
                out[f"t_{name}"] = F.lit(None).cast("bigint")
        return out

    def share(self) -> None:
        """From now on write down what several stages read; what was built lazily before is built anew."""
        if not self.sharing:
            self.sharing = True
            for name in self._shared:
                getattr(self, name).cache_clear()

    def _with_ghosts(self, m: Mapping) -> DataFrame:
        """A mapping's rows, and a tombstone for every recorded member whose row is gone."""
        rows = self.forward(m.name)
        known = self.state.get(f"_cluster_members_{m.name}")
        if not m.derive_tombstones or known is None:
            return rows
        gone = known.select(F.col("_src_id").cast("string").alias("__pk")).join(rows.select("__pk"), "__pk", "left_anti")
        columns = {c: F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns}
        columns |= {"__m": F.lit(m.name), "__decl": F.lit(m.order), "__pk": F.col("__pk"), "__row": F.concat_ws(":", F.lit(m.name), "__pk"), "__ghost": F.lit(True), "__soft": F.lit(False), f"v_{m.derive_tombstones}": F.lit("true")}
        columns |= {c: F.lit(False) for c in rows.columns if c.startswith("h_")}
        return rows.unionByName(gone.select(*[v.alias(c) for c, v in columns.items()]))

    def _edges(self, target: str) -> DataFrame | None:
        """Edges beyond shared values: recorded members, fed-back cluster ids and link tables."""
        node = lambda m, pk: F.concat_ws(":", F.lit("r"), F.lit(m), pk)
        found = []
        for m in self.doc.into(target):
            known = self.state.get(f"_cluster_members_{m.name}")
            if m.cluster_members and known is not None:
                found.append(known.select(node(m.name, F.col("_src_id").cast("string")).alias("a"), F.concat(F.lit("c:"), F.col("_cluster_id").cast("string")).alias("b")))
            if m.cluster_field:
                found.append(self.forward(m.name).where("__cluster is not null").select(node(m.name, F.col("__pk")).alias("a"), F.concat(F.lit("c:"), "__cluster").alias("b")))
            if m.links or m.link_key:
                rows = self.scope.rows(m)
                for x in m.links:
                    to = self.scope.value(m, x["field"])
                    found.append(rows.where(to.isNotNull()).select(node(m.name, F.col("__pk")).alias("a"), node(x["references"], to).alias("b")))
                if m.link_key:
                    key = self.scope.value(m, m.link_key)
                    found.append(rows.where(key.isNotNull()).select(node(m.name, F.col("__pk")).alias("a"), F.concat(F.lit(f"l:{m.name}:"), key).alias("b")))
        return reduce(DataFrame.union, found) if found else None

    def _linked(self, target: str) -> DataFrame:
        """Contributions with every reference looked up and derived timestamps set."""
        every = self.references(target)
        rows = self.identified(target)
        rest = {f for f in every if f"e_{f}" not in rows.columns}
        parts = []
        for m in self.doc.into(target):
            df = self._link(m, rows.where(F.col("__m") == m.name), rest) if rest else rows.where(F.col("__m") == m.name)
            parts.append(self._derived_times(m, df))
        return reduce(_union, parts) if rest or any(m.derive_timestamps for m in self.doc.into(target)) else rows

    def written(self, m: Mapping) -> DataFrame | None:
        """(__id, __written, __at, __ts) of what was last written for each entity."""
        table = self.state.get(f"_written_{m.name}")
        if table is None or not m.written_state:
            return None
        rows = self.identified(m.target)
        names = [rows.select(F.col("__row").alias("alias"), "__id"), rows.select(F.concat_ws(":", "__m", "__pk").alias("alias"), "__id"), rows.where("__cluster is not null").select(F.col("__cluster").alias("alias"), "__id")]
        for x in self.doc.into(m.target):
            known = self.state.get(f"_cluster_members_{x.name}")
            if known is not None:
                own = rows.where(F.col("__m") == x.name).select("__pk", "__id")
                names.append(known.join(own, known["_src_id"].cast("string") == own["__pk"]).select(F.col("_cluster_id").cast("string").alias("alias"), "__id"))
        alias = reduce(DataFrame.union, names).distinct()
        kind = "map<string,string>"
        get = lambda c: F.from_json(F.col(c).cast("string"), kind) if c in table.columns else F.lit(None).cast(kind)
        at = F.col("_written_at").cast("string") if "_written_at" in table.columns else F.lit(None).cast("string")
        held = table.select(F.col("_cluster_id").cast("string").alias("alias"), get("_written").alias("__written"), at.alias("__at"), get("_written_ts").alias("__ts"))
        return held.join(alias, "alias").groupBy("__id").agg(F.max_by(F.struct("__written", "__at", "__ts"), F.coalesce("__at", F.lit(""))).alias("w")).select("__id", "w.*")

    def _derived_times(self, m: Mapping, df: DataFrame) -> DataFrame:
        state = self.written(m) if m.derive_timestamps else None
        if state is None:
            return df
        df = df.join(state, "__id", "left")
        micros = lambda c: F.unix_micros(c.try_cast("timestamp"))
        for f in m.fields:
            if not f.forward or f.source is None:
                continue
            before = F.try_element_at("__written", F.lit(f.source))
            derived = F.when(before.isNull(), None).when(before == F.col(f"v_{f.target}"), micros(F.try_element_at("__ts", F.lit(f.source)))).otherwise(micros(F.col("__at")))
            df = df.withColumn(f"t_{f.target}", F.coalesce(f"t_{f.target}", derived))
        return df.drop("__written", "__at", "__ts")

    def contributions(self, target: str, alive: bool = True) -> DataFrame:
        """What resolution sees (``alive``), or every row."""
        rows = self._linked(target)
        if not alive:
            return rows
        t = self.doc.targets[target]
        link = next((f for f in t.fields if self.referred(target, f)), None)
        rows = resolve.with_authority(self.doc, t, rows.where(~F.col("__soft")), link)
        return resolve.without_echoes(self.doc, t, rows)

    def _resolved(self, target: str) -> DataFrame:
        null_wins = {f.target for m in self.doc.into(target) for f in m.fields if f.null_wins}
        return resolve.golden(self.doc.targets[target], self.contributions(target), self.references(target), null_wins, tuple(m.name for m in self.doc.into(target) if m.array and any(f.order for f in m.fields)))

    def golden(self, target: str) -> DataFrame:
        """One row per entity: ``__id`` and the resolved fields."""
        t = self.doc.targets[target]
        out = resolve.enriched(self.doc, t, self._resolved, self.referred) if any(map(resolve.is_enriched, t.fields.values())) else self._resolved(target)
        return out.persist() if self.keep else out

    def members(self, m: Mapping) -> DataFrame:
        """A mapping's real rows with their entities; a row without a key contributes, but can't be written to."""
        rows = self._linked(m.target).where((F.col("__m") == m.name) & ~F.col("__ghost") & F.col("__pk").isNotNull())
        return rows.withColumnRenamed(f"__own_{m.name}", "__own")

    def frame(self, mapping: str) -> DataFrame:
        self.share()
        m = self.doc.mappings[mapping]
        return classified(self.reverse.frame(m), self.may_insert(m), self.written(m) if m.derive_noop else None)

    def may_insert(self, m: Mapping) -> bool:
        return not m.embedded and bool(self.reverse.lines(m))

    # results

    def record(self, target: str, hashed: bool = False) -> DataFrame:
        """The golden record as users see it: ``_canonical_id`` and the target's fields.

        Fields of array types are arrays, and what ``target_path`` lines make up
        is a struct; every other value is text.  ``hashed`` adds
        ``_identity_hash``: SHA-256 of the first identity group's values, parted
        by U+001F; it doesn't depend on which rows an entity has.  U+001E stands
        before a U+001F or U+001E of a value, and with a 0 for a NULL.
        """
        t, g, entity = self.doc.targets[target], self.golden(target), self.doc.named("_canonical_id")
        parts = {p for c in t.composites.values() for p in _leaves(c)}
        fields = [self._typed(f, F.col(f"v_{f.name}")).alias(f.name) for f in t.fields.values() if f.name not in parts]
        fields += [self._composite(t, c).alias(name) for name, c in t.composites.items()]
        if hashed:
            plain = [F.coalesce(F.regexp_replace(f"v_{f}", "([\x1e\x1f])", "\x1e$1"), F.lit("\x1e0")) for f in t.identity[0]]
            fields.append(F.sha2(F.concat_ws("\x1f", *plain), 256).alias(self.doc.named("_identity_hash")))
        return g.select(F.col("__id").alias(entity), *fields)

    def _typed(self, f, value: Column) -> Column:
        if not f.element:
            return value
        kind = _ELEMENTS.get(f.element.lower())
        if f.element.lower() in ("jsonb", "json"):
            return F.from_json(value, "array<variant>")
        items = F.from_json(value, "array<string>")
        return items if kind is None else F.transform(items, lambda x: x.try_cast(kind))

    def _composite(self, t, parts: dict) -> Column:
        return F.struct(*[(self._composite(t, p) if isinstance(p, dict) else self._typed(t.fields[p], F.col(f"v_{p}"))).alias(n) for n, p in parts.items()])

    def deltas(self, mapping: str) -> Deltas:
        m = self.doc.mappings[mapping]
        shape = Shape(
            key=[] if m.array else list(self.doc.source_of(m).primary_key),
            columns=self._columns(m),
            passthrough=list(m.passthrough),
            own=lambda n: self.scope.own_text(m, n),
            base=self.scope.own_names(m) if m.include_base else None,
            gates=dict(m.confirm) if m.gated else None,
            entity=self.doc.named("_canonical_id"),
            action=self.doc.named("_action"),
        )
        d = deltas(self.frame(mapping), shape)
        renamed = {n: self.doc.named(n) for n in ("_base", "_requires_confirmation") if self.doc.named(n) != n}
        return Deltas(*[x.withColumnsRenamed(renamed) for x in (d.updates, d.inserts, d.deletes, d.noops)], d.action) if renamed else d

    def _columns(self, m: Mapping) -> list[str]:
        if not m.array:
            return self.reverse.columns(m)
        return [f.source for f in self.reverse.lines(m) if f.source] + [c.array[0] for c in self.doc.children(m.name) if c.array]

    def visible(self) -> list[str]:
        """Mappings that have deltas of their own: in version 2 all, in version 1 those that aren't part of a parent's row."""
        return [m.name for m in self.doc.mappings.values() if (self.doc.version == "2.0" or not m.parent) and (self.reverse.columns(m) or m.array)]

    def provenance(self, target: str) -> DataFrame:
        """Which mapping and row each entity is made of."""
        columns = {"__id": "_canonical_id", "__m": "_mapping", "__pk": "_src_pk", "__ghost": "_tombstone", "__soft": "_soft_deleted"}
        return self._linked(target).select(*[F.col(c).alias(self.doc.named(n)) for c, n in columns.items()])

    def contributed(self, target: str) -> DataFrame:
        """Every value offered for every field, and whether it won: one pass over the contributions, joined with their entity."""
        t = self.doc.targets[target]
        self.share()
        named = self.doc.named
        offers = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v_{f}").alias("value"), F.col(f"p_{f}").alias("priority"), F.timestamp_micros(f"t_{f}").alias("last_modified")) for f in t.fields])
        won = self.golden(target).select(F.col("__id").alias("__w"), F.map_from_arrays(F.array(*map(F.lit, t.fields)), F.array(*[F.col(f"v_{f}") for f in t.fields])).alias("__won"))
        rows = self.contributions(target).select("__id", "__m", "__pk", F.filter(offers, lambda x: x["value"].isNotNull()).alias("__offers")).join(won, F.col("__id") == F.col("__w"), "left")
        out = rows.select("__id", "__m", "__pk", "__won", F.explode("__offers").alias("x"))
        return out.select(
            F.col("__id").alias(named("_canonical_id")), F.col("x.field").alias("field"), F.col("__m").alias(named("_mapping")), F.col("__pk").alias(named("_src_pk")), "x.value", "x.priority", "x.last_modified", F.col("x.value").eqNullSafe(F.col("__won")[F.col("x.field")]).alias("wins")
        )

    def element_deltas(self, mapping: str) -> DataFrame:
        """An array mapping's elements against what its parent last wrote: ``_element_action`` insert, present or delete.

        The parent's ``_written`` state holds whole objects; elements are told
        apart by their identity without the fields that link them to the parent.
        """
        self.share()
        m = self.doc.mappings[mapping]
        parent = self.doc.mappings[m.parent]
        entity, action_name = self.doc.named("_canonical_id"), self.doc.named("_element_action")
        state = self.written(parent)
        keys = [f for f in self.reverse.lines(m) if f.target in {x for g in self.doc.targets[m.target].identity for x in g}]
        now = self.reverse.elements(m).select("parent", F.explode("items").alias("x"))
        now = now.select("parent", *[F.col("x")[f.source].alias(f.source) for f in keys])
        if state is None:
            return now.withColumn(action_name, F.lit("insert")).withColumnRenamed("parent", entity)
        before = state.select(F.col("__id").alias("parent"), F.explode(self.reverse.own_elements(m, F.try_element_at("__written", F.lit(m.array[0])))).alias("x"))
        before = before.select("parent", *[F.col("x")[f.source].alias(f.source) for f in keys]).distinct()
        names = ["parent", *[f.source for f in keys]]
        both = now.withColumn("__now", F.lit(True)).join(before.withColumn("__before", F.lit(True)), names, "full")
        action = F.when(F.col("__before").isNull(), "insert").when(F.col("__now").isNull(), "delete").otherwise("present")
        return both.select(F.col("parent").alias(entity), *names[1:], action.alias(action_name))

    def create_views(self, prefix: str = "") -> list[str]:
        """A temporary view per stage: forward, identified, golden record, reverse and deltas; their names."""
        self.share()
        views = {f"{m}_forward": self.forward(m) for m in self.doc.mappings}
        for t in self.doc.targets:
            views |= {f"{t}_identified": self.identified(t), t: self.record(t)}
        for m in self.visible():
            d = self.deltas(m)
            views |= {f"{m}_reverse": self.frame(m), f"{m}_updates": d.updates, f"{m}_inserts": d.inserts, f"{m}_deletes": d.deletes, f"{m}_changes": d.changes()}
        for name, df in views.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + n for n in views]

    def write(self, folder: str, unique: bool = True) -> list[str]:
        """Write golden records and deltas as Parquet tables, one folder each; their names.

        ``unique`` first asserts their keys: an entity occurs once in a golden
        record, and an entity with a row's key once in a mapping's deltas (an
        entity may have several rows, NULL keys count as equal).
        """
        entity = self.doc.named("_canonical_id")
        out = {t: (self.record(t), [entity]) for t in self.doc.targets}
        for m in self.visible():
            d = self.deltas(m)
            spec = self.doc.mappings[m]
            # the deltas of elements hold no key of a row
            key = [entity, *self.doc.source_of(spec).primary_key] if not spec.array else []
            out |= {f"{m}_{kind}": (getattr(d, kind), key) for kind in ("updates", "inserts", "deletes")}
        for name, (df, key) in out.items():
            if unique and key:
                assert_unique(df, key, name)
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return list(out)

    def sync_status(self, mapping: str) -> DataFrame:
        """Entities by what has to happen to them in a mapping."""
        return self.frame(mapping).select(F.col("__id").alias(self.doc.named("_canonical_id")), F.col("__pk").alias(self.doc.named("_src_pk")), F.coalesce("_action", F.lit("none")).alias("status"))


def assert_unique(df: DataFrame, key: list[str], name: str) -> None:
    """Raise ``NotUnique`` with an example if two rows of ``df`` have the same key; NULLs count as equal."""
    twice = df.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").first()
    if twice is not None:
        raise NotUnique(f"{name}: {', '.join(f'{k}={twice[k]!r}' for k in key)} occurs {twice['__n']} times")


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each mapping has a column of its own for its rows' values."""
    return a.unionByName(b, allowMissingColumns=True)


def _leaves(parts: dict) -> list[str]:
    return [x for p in parts.values() for x in (_leaves(p) if isinstance(p, dict) else [p])]
