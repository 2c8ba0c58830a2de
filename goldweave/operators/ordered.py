"""Order of array elements that is kept as links to their neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def walk(elements: Sequence[tuple[str, str | None, str | None]]) -> list[int]:
    """Indexes of (own name, name before, name after) in the order that the links say.

    Walks start at elements with no element before them.  Of several that claim
    the same place, one that names another of them as its follower goes first,
    then the one that the element before names, then the least name; each with
    all that follows it.  What only a circle leads to comes last, from its least
    name on.  Every index occurs once.
    """
    by_name: dict[str, int] = {}
    for i, (name, _, _) in enumerate(elements):
        by_name.setdefault(name, i)
    followers: dict[int | None, list[int]] = {}
    for i, (_, before, _) in enumerate(elements):
        at = by_name.get(before) if before is not None else None
        followers.setdefault(at if at != i else None, []).append(i)
    for at, held in followers.items():
        names = {elements[i][0] for i in held}
        named = elements[at][2] if at is not None else None
        held.sort(key=lambda i, names=names, named=named: (elements[i][2] not in names, elements[i][0] != named, elements[i][0], i), reverse=True)
    out: list[int] = []
    seen = [False] * len(elements)
    stack = list(followers.get(None, ()))
    rest = iter(sorted(range(len(elements)), key=lambda i: (elements[i][0], i)))
    while len(out) < len(elements):
        if not stack:
            stack.append(next(i for i in rest if not seen[i]))
        i = stack.pop()
        if not seen[i]:
            seen[i] = True
            out.append(i)
            stack += followers.get(i, ())
    return out


def linked_positions(rows: DataFrame, identity: list[str], before: Column, after: Column) -> DataFrame:
    """``rows`` (elements with ``parent`` and ``__id``) with ``__chain``, an element's place among those of its parent.

    The elements of a parent, which become one array in the end, are walked
    together; only their names and links are exchanged for that.
    """
    name = F.col(f"v_{identity[0]}") if len(identity) == 1 else F.to_json(F.struct(*[F.col(f"v_{f}").alias(f) for f in identity]))
    links = rows.where("parent is not null").select("parent", "__id", F.coalesce(name, F.lit("")).alias("name"), before.alias("before"), after.alias("after"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("name", "ascending"), ("__id", "ascending")])
        order = walk(list(zip(*(table.column(c).to_pylist() for c in ("name", "before", "after")), strict=True)))
        return pa.table({"__e": table.column("__id").take(pa.array(order, pa.int64())), "__chain": pa.array(range(len(order)), pa.int64())})

    places = links.groupBy("parent").applyInArrow(place, "__e string, __chain bigint")
    return rows.join(places, F.col("__id") == F.col("__e"), "left").drop("__e")
