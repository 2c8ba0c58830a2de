"""Updates, inserts, deletes and noops of one mapping."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TooManyChanges(RuntimeError):
    """Deltas beyond the limits that a caller set."""


@dataclass(frozen=True)
class Deltas:
    """What a source must change; lazy frames that share one classified frame."""

    updates: DataFrame
    inserts: DataFrame
    deletes: DataFrame
    noops: DataFrame
    action: str = "_action"

    def changes(self) -> DataFrame:
        """All of them with ``_action``; columns that one lacks are NULL."""
        parts = [d.withColumn(self.action, F.lit(a)) for a, d in (("update", self.updates), ("insert", self.inserts), ("delete", self.deletes))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


def guarded(d: Deltas, **limits: int) -> Deltas:
    """``d``, unless it has more ``updates``, ``inserts`` or ``deletes`` than allowed: a circuit breaker before writing."""
    for kind, most in limits.items():
        found = getattr(d, kind).limit(most + 1).count()
        if found > most:
            raise TooManyChanges(f"more than {most} {kind}")
    return d


def classified(frame: DataFrame, may_insert: bool, written: DataFrame | None = None) -> DataFrame:
    """``frame`` with ``_action``.

    No row: an insert if the entity passes.  A soft-deleted row: nothing.  A
    row whose entity fails: a delete.  Else a noop if nothing differs or, with
    ``written`` state, if everything is as it was written; else an update.
    """
    there = F.col("__pk").isNotNull()
    same = ~F.col("differs")
    if written is not None:
        frame = frame.join(written.select("__id", "__written"), "__id", "left")
        pairs = F.map_entries("out")
        as_written = F.col("__written").isNotNull() & F.forall(pairs, lambda e: e["value"].eqNullSafe(F.try_element_at("__written", e["key"])))
        same = same | as_written
    action = (
        F.when(~there, F.when(F.col("__pass") & F.lit(may_insert), "insert"))
        .when(F.col("__soft"), None)
        .when(~F.col("__pass"), "delete")
        .when(same, "noop")
        .otherwise("update")
    )
    return frame.withColumn("_action", action)


@dataclass(frozen=True)
class Shape:
    """What the rows of a mapping's deltas hold.

    ``own`` gives the row's own text of a column; ``key`` and ``columns`` are
    written, ``passthrough`` and, for ``base``, the whole row are its own.
    ``gates`` says which actions always need confirmation, if any ever do.
    """

    key: list[str]
    columns: list[str]
    passthrough: list[str]
    own: Callable[[str], Column]
    base: list[str] | None = None
    gates: dict[str, bool] | None = None
    entity: str = "_canonical_id"
    action: str = "_action"


def deltas(rows: DataFrame, shape: Shape) -> Deltas:
    """Wide frames from classified rows."""
    out = lambda n: F.try_element_at("out", F.lit(n))
    null = lambda n: F.lit(None).cast("string")
    own = shape.own
    keys = [k for k in shape.key if k not in shape.columns]
    kept = lambda n: F.coalesce(own(n), out(n)) if n in shape.key else out(n)

    def picked(action: str, value, key_value) -> DataFrame:
        extra: list[Column] = [own(n).alias(n) for n in shape.passthrough if n not in shape.columns and n not in keys]
        if shape.base is not None:
            whole = F.to_json(F.struct(*[own(n).alias(n) for n in shape.base]), {"ignoreNullFields": "false"})
            extra.append((whole if action != "insert" else F.lit(None).cast("string")).alias("_base"))
        if shape.gates is not None:
            asked = F.lit(shape.gates.get(action, False)) | F.col("__ask_when") | (F.col("__ask_field") if action in ("update", "insert") else F.lit(False))
            extra.append((asked if action != "noop" else F.lit(False)).alias("_requires_confirmation"))
        found = rows.where(F.col("_action") == action)
        return found.select(F.col("__id").alias(shape.entity), *[key_value(k).alias(k) for k in keys], *[value(n).alias(n) for n in shape.columns], *extra)

    return Deltas(picked("update", kept, own), picked("insert", out, null), picked("delete", own, own), picked("noop", kept, own), shape.action)
