"""Clustering: which contributions describe one entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.operators.components import components
from goldweave.plans.model import Document, Target


def group_key(target: Target, group: tuple[str, ...], references: set[str]) -> Column:
    """The group's values as one text, each after its length; NULL if any is.  A reference counts as the entity it leads to, else as its text."""
    parts = [F.coalesce(F.concat(F.lit("e:"), f"e_{f}"), F.concat(F.lit("v:"), f"v_{f}")) if f in references else F.col(f"v_{f}") for f in group]
    return F.concat(F.lit("k"), *[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])


def least_row(rows: DataFrame, key: str, grouped: Column) -> DataFrame:
    """``rows`` with ``__id``, the least row id of those that share ``key`` (a row that isn't ``grouped``: its own).

    An aggregation and a join instead of a window: a hot key is summed up before
    the exchange, and adaptive execution can split its side of the join.
    """
    least = rows.where(grouped).groupBy(F.col(key).alias("__k")).agg(F.min("__row").alias("__least"))
    out = rows.join(least, F.col(key) == F.col("__k"), "left")
    return out.withColumn("__id", F.coalesce("__least", "__row")).drop("__k", "__least", key)


def cluster(doc: Document, target: Target, rows: DataFrame, references: set[str], edges: DataFrame | None) -> DataFrame:
    """``rows`` with ``__id``, the least row id of each row's cluster.

    One identity group and no further edges: the least row of each key.  Several
    groups, links or fed-back cluster ids: connected components.  A row without
    any complete key is an entity of its own.
    """
    if edges is None and not target.identity:
        return rows.withColumn("__id", F.col("__row"))
    if edges is None and len(target.identity) == 1:
        key = group_key(target, target.identity[0], references)
        # a row without a key gets a text of its own: such rows neither match nor meet in one task
        keyed = rows.withColumn("__key", F.coalesce(key, F.concat_ws(":", F.lit("r"), "__m", "__pk")))
        return least_row(keyed, "__key", F.col("__key").startswith("k"))
    node = F.concat_ws(":", F.lit("r"), "__m", "__pk")
    found = [rows.select(node.alias("a"), F.concat(F.lit(f"k{i}:"), group_key(target, g, references)).alias("b")).where("b is not null") for i, g in enumerate(target.identity)]
    found += [rows.where("__cluster is not null").select(node.alias("a"), F.concat(F.lit("c:"), "__cluster").alias("b"))]
    found += [] if edges is None else [edges.select("a", "b")]
    linked = components(reduce(DataFrame.union, found), "identity")
    rooted = rows.withColumn("__node", node).join(linked, F.col("__node") == linked["id"], "left").drop("id")
    rooted = rooted.withColumn("__root", F.coalesce("root", "__node")).drop("root", "__node")
    return least_row(rooted, "__root", F.lit(True))
