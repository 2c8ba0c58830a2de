"""Where a document's sources and state tables come from."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldweave.plans.model import Document


def from_rows(spark: SparkSession, rows: list[dict[str, Any]], columns: list[str] = ()) -> DataFrame:
    """Inline rows as text columns; a list or a mapping becomes JSON text.

    ``columns`` are added where no row has them, so that an empty source has a schema.
    """
    names = list(dict.fromkeys([c for r in rows for c in r] + list(columns)))

    def text(v: Any) -> str | None:
        if v is None or isinstance(v, str):
            return v
        if isinstance(v, bool):
            return "true" if v else "false"
        return json.dumps(v, sort_keys=True, ensure_ascii=False, default=str)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(text(r.get(n)) for n in names) for r in rows], schema)


def read(spark: SparkSession, doc: Document, places: dict[str, str], fmt: str = "parquet", **options: Any) -> dict[str, DataFrame]:
    """The document's sources from files (any format that Spark reads) or, for ``table``, from the catalog.

    A source that no place is given for lies where its ``table`` says, else under its name.
    """
    out = {}
    for name, source in doc.sources.items():
        place = places.get(name, source.table or name)
        out[name] = spark.table(place) if fmt == "table" else spark.read.format(fmt).options(**options).load(place)
    return out


def columns_used(doc: Document, source: str) -> list[str]:
    """Every column of a source that the document names."""
    names = list(doc.sources[source].primary_key)
    for m in doc.mappings.values():
        if m.source != source:
            continue
        chain = _levels(doc, m)
        top = not any(x.array for x in chain)
        if top:
            names += [f.source for f in m.fields if f.source] + [c for f in m.fields for c in f.sources] + list(m.passthrough) + [m.cluster_field, m.link_key, *[x["field"] for x in m.links], (m.soft_delete or {}).get("field")]
            names += [t for t in (m.last_modified, *[f.last_modified for f in m.fields]) if isinstance(t, str)]
            names += [f.source_path.split(".")[0].split("[")[0] for f in m.fields if f.source_path]
        elif m.array and not any(x.array for x in chain[1:]):
            names += [m.array[0]] + [a for a in m.parent_fields.values() if isinstance(a, str)] + [a["field"] for a in m.parent_fields.values() if isinstance(a, dict)]
    return [n for n in dict.fromkeys(names) if n]


def _levels(doc: Document, m) -> list:
    out = [m]
    while out[-1].parent:
        out.append(doc.mappings[out[-1].parent])
    return out


def text_of(value: Column, kind: T.DataType) -> Column:
    """A value as text: nested ones as JSON, everything else cast."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    return value.cast("string")


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text."""
    return text_of(F.col(f"`{name}`"), df.schema[name].dataType)


def row_key(pk: str) -> str:
    """An opaque text as the last part of an IRI: everything outside the unreserved characters percent-encoded."""
    from urllib.parse import quote

    return quote(pk, safe="-._~")


def encode_key(column: Column) -> Column:
    """``row_key`` for a column."""
    out = F.url_encode(column)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def decode_key(column: Column) -> Column:
    """Exact inverse of ``encode_key``."""
    return F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B")))
