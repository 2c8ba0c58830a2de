"""More mapping documents over the driver's tables: one group for each kind of field, reference, array and delta.

As in ``showcase``, the systems are views of the tables in SQL that Spark and
DuckDB both read, or are built with the DataFrame API where they hold arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.plans.model import parse
from goldweave.plans.pipeline import Pipeline
from goldweave.plans.showcase import NUMBERED, SYSTEMS, system

_KEY = "CAST(c_custkey AS STRING)"
_MAIL = f"'c' || {_KEY} || '@example.com'"

MORE = {
    "profiles": f"""SELECT 'P' || {_KEY} AS id, {_MAIL} AS mail, '{{{{ "n": ' || CAST(c_custkey % 50 AS STRING) || ', "f":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "home":{{{{"zip":"07", "city":"town ' || CAST(c_nationkey AS STRING) || '"}}}}, "k":[1,2.5,null]}}}}' AS doc FROM {{customer}}""",
    "desk": f"""SELECT 'D' || {_KEY} AS id, {_MAIL} AS mail, CAST(c_custkey % 50 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS STRING) AS n, CASE WHEN c_custkey % 10 = 0 THEN 'false' WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag,
      CASE WHEN c_custkey % 7 = 0 THEN 'moved' ELSE 'town ' || CAST(c_nationkey AS STRING) END AS city FROM {{customer}} WHERE c_custkey % 4 <> 1""",
    "people": f"""SELECT {_KEY} AS id, c_name AS full_name, {_MAIL} AS mail, CAST(c_acctbal AS STRING) AS bal, CAST(DATE '2024-01-01' + CAST(c_custkey % 97 AS INT) AS STRING) AS since, c_mktsegment AS seg, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'x' || {_KEY} END AS code,
      '{{{{"phones":[{{{{"no":"' || CAST(c_custkey % 1000 AS STRING) || '"}}}}]}}}}' AS extra, CASE WHEN c_custkey % 6 = 0 THEN 'yes' WHEN c_custkey % 6 = 1 THEN 'true' ELSE 'false' END AS agreed FROM {{customer}}""",
    "cards": f"""SELECT 'K' || {_KEY} AS id, {_MAIL} AS mail, 'Customer' AS first, {_KEY} AS last, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'B' END AS seg_code, CAST(DATE '2024-01-01' + CAST(c_custkey % 50 AS INT) AS STRING) AS from_day, CAST(DATE '2024-01-01' + CAST(c_custkey % 90 AS INT) AS STRING) AS to_day
      FROM {{customer}} WHERE c_custkey % 2 = 0""",
    "firms": "SELECT 'S' || CAST(s_suppkey AS STRING) AS id, 'w' || CAST(CAST(floor(s_suppkey / 2.0) AS BIGINT) AS STRING) AS web, s_name AS title FROM {supplier}",
    "staff": f"""SELECT {_KEY} AS id, {_MAIL} AS mail, 'S' || CAST(c_custkey % (SELECT max(s_suppkey) FROM {{supplier}}) + 1 AS STRING) AS firm_id FROM {{customer}}""",
    "lands": "SELECT n_name AS name, 'N' || CAST(n_nationkey AS STRING) AS iso FROM {nation}",
    "coded": f"SELECT 'X' || {_KEY} AS id, {_MAIL} AS mail, 'N' || CAST(c_nationkey AS STRING) AS code FROM {{customer}} WHERE c_custkey % 3 <> 0",
    "spelled": f"SELECT 'Y' || {_KEY} AS id, {_MAIL} AS mail, CASE WHEN c_custkey % 10 = 0 THEN 'ATLANTIS' ELSE n_name END AS land FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 1",
    "heads": "SELECT 'H' || CAST(o_orderkey AS STRING) AS no, CAST(o_orderkey AS STRING) AS ref FROM {orders} WHERE o_orderkey % 16 = 0",
    "tops": "SELECT 'T' || CAST(o_orderkey AS STRING) AS id, CAST(o_orderkey AS STRING) AS ref FROM {orders} WHERE o_orderkey % 16 = 0 AND o_orderkey % 5 <> 0",
    "items": "SELECT 'H' || CAST(o_orderkey AS STRING) AS no, '1' AS n, o_orderpriority AS good FROM {orders} WHERE o_orderkey % 16 = 0 AND o_orderkey % 3 = 0",
    "notes": "SELECT 'N' || CAST(o_orderkey AS STRING) AS id, 'T' || CAST(o_orderkey AS STRING) AS top, o_orderstatus AS good FROM {orders} WHERE o_orderkey % 16 = 0 AND o_orderkey % 7 = 0",
    "left_rows": f"SELECT 'A' || {_KEY} AS id, c_name AS title, c_mktsegment AS seg FROM {{customer}} WHERE c_custkey % 4 <> 3",
    "right_rows": f"SELECT 'B' || {_KEY} AS id, upper(c_name) AS name FROM {{customer}} WHERE c_custkey % 4 <> 0",
    "pairs": f"SELECT 'Q' || {_KEY} AS id, 'A' || {_KEY} AS a, 'B' || {_KEY} AS b, 'G' || CAST(CAST(floor(c_custkey / 10.0) AS BIGINT) AS STRING) AS grp FROM {{customer}} WHERE c_custkey % 5 = 2",
    "flat": f"SELECT 'F' || {_KEY} AS id, 'w' || CAST(c_nationkey AS STRING) AS web, c_name AS who, {_MAIL} AS mail, CAST(DATE '2024-01-01' + CAST(c_custkey % 97 AS INT) AS STRING) AS at FROM {{customer}} WHERE c_custkey % 2 = 0",
    "book": f"SELECT 'C' || {_KEY} AS id, upper(c_name) AS name, {_MAIL} AS mail, CAST(DATE '2024-01-01' + CAST((c_custkey * 7) % 97 AS INT) AS STRING) AS at FROM {{customer}} WHERE c_custkey % 3 <> 0",
    "buyers": f"SELECT {_KEY} AS id, c_name AS name FROM {{customer}} WHERE c_custkey % 2 = 0",
    "sales": "SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS buyer, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS sum FROM {orders}",
    "kinds": f"SELECT {_KEY} AS id, {_MAIL} AS mail, CASE c_custkey % 5 WHEN 0 THEN 'vip' WHEN 1 THEN 'plain' WHEN 2 THEN 'lead' WHEN 3 THEN 'gold vip' ELSE 'buyer' END AS kind, c_name AS name, 'r' || CAST(c_custkey % 3 AS STRING) AS region FROM {{customer}}",
    "sink": f"SELECT 'Z' || {_KEY} AS id, {_MAIL} AS mail, CASE WHEN c_custkey % 4 = 0 THEN 'old ' || c_name ELSE c_name END AS name FROM {{customer}} WHERE c_custkey % 2 = 0",
    "odd": f"""SELECT {_KEY} AS `order`, c_name AS `Contact Name`, {_MAIL} AS `e-mail`, c_mktsegment AS `_mapping` FROM {{customer}}""",
    "patrons": f"SELECT {_KEY} AS id, {_MAIL} AS mail, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN '2024-02-03' END AS left_on FROM {{customer}}",
    "guests": f"SELECT 'U' || {_KEY} AS id, {_MAIL} AS mail, upper(c_name) AS name FROM {{customer}} WHERE c_custkey % 3 = 0",
}


def _plain(sql: str) -> str:
    """A system's SQL as DuckDB reads it."""
    out = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", sql).replace("{{", "{").replace("}}", "}")
    return re.sub(r"`([^`]*)`", r'"\1"', out)


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({_plain((MORE | SYSTEMS)[n])})" for n in names)


def pipeline(spark: SparkSession, d: str, text: str, more: dict[str, DataFrame] | None = None, state: dict[str, DataFrame] | None = None) -> Pipeline:
    doc = parse(text)
    return Pipeline(doc, {n: (more or {}).get(n) if n in (more or {}) else system(spark, d, (MORE | SYSTEMS)[n]) for n in doc.sources}, state)


def _id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("_canonical_id", "canonical_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


# documents in a column

DOCUMENTS = """
version: "1.0"
sources: { profiles: { primary_key: id }, desk: { primary_key: id } }
targets: { client: { fields: { mail: { strategy: identity }, n: { strategy: coalesce }, flag: { strategy: coalesce }, city: { strategy: coalesce }, whole: { strategy: coalesce, type: jsonb } } } }
mappings:
  - { name: profiles, source: profiles, target: client, priority: 2, fields: [{ source: mail, target: mail }, { source_path: doc.n, target: n }, { source_path: doc.f, target: flag }, { source_path: doc.home.city, target: city }, { source: doc, target: whole, direction: forward_only }] }
  - { name: desk, source: desk, target: client, priority: 1, fields: [{ source: mail, target: mail }, { source: n, target: n }, { source: flag, target: flag }, { source: city, target: city }] }
"""
_PROFILES = _with("profiles", "desk") + ", j AS (SELECT p.id, p.mail, d.id AS did, CAST(substr(p.id, 2) AS BIGINT) AS k, d.n, d.flag, d.city, p.doc FROM profiles p LEFT JOIN desk d ON p.mail = d.mail)"


@query(
    _PROFILES
    + """ SELECT id, '{"f":' || flag || ',"home":{"city":"' || city || '","zip":"07"},"k":[1,2.5,null],"n":' || n || '}' AS doc FROM j
    WHERE did IS NOT NULL AND (n <> CAST(k % 50 AS STRING) OR flag <> CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END OR city = 'moved')"""
)
def json_writeback(spark: SparkSession, d: str) -> DataFrame:
    """Values at paths of a document, written back with their types; the rest of it stays."""
    return pipeline(spark, d, DOCUMENTS).deltas("profiles").updates.select("id", "doc")


@query(_PROFILES + """ SELECT mail, '{"f":' || (doc ->> '$.f') || ',"home":{"city":"' || (doc ->> '$.home.city') || '","zip":"07"},"k":[1,2.5,null],"n":' || (doc ->> '$.n') || '}' AS whole FROM j""")
def json_opaque(spark: SparkSession, d: str) -> DataFrame:
    """A document that is one value, in canonical form."""
    return pipeline(spark, d, DOCUMENTS).record("client").where("whole is not null").select("mail", "whole")


# fields that are computed, cast, joined, mapped

FIELDS = """
version: "1.0"
sources: { people: { primary_key: id }, cards: { primary_key: id } }
targets:
  person:
    fields:
      mail: { strategy: identity }
      short: { strategy: coalesce }
      day: { strategy: coalesce }
      cents: { strategy: coalesce }
      letters: { strategy: coalesce }
      phone: { strategy: coalesce }
      size: { strategy: coalesce }
      agreed: { strategy: coalesce }
      whole: { strategy: coalesce, type: integer }
      full: { strategy: coalesce }
      seg: { strategy: coalesce }
      note: { strategy: coalesce, default: { sql: "'none for ' || mail" } }
      tier: { strategy: coalesce, default: { value: basic } }
      again: { strategy: coalesce }
mappings:
  - name: people
    source: people
    target: person
    priority: 2
    fields:
      - { source: mail, target: mail }
      - { target: short, expression: "upper(left(full_name, 4)) || '-' || lpad(id, 8, '0')" }
      - { target: day, expression: "to_char(since::timestamptz, 'DD.MM.YYYY')" }
      - { target: cents, expression: "bal::numeric(12,1)::text" }
      - { target: letters, expression: "regexp_replace(split_part(full_name, '#', 2), '0', '', 'g')" }
      - { target: phone, expression: "extra->'phones'->0->>'no'" }
      - { target: size, expression: "CASE WHEN bal::numeric > 5000 THEN 'big' WHEN bal::numeric < 0 THEN 'debt' ELSE 'small' END" }
      - { source: agreed, target: agreed, cast: boolean }
      - { source: id, target: whole, cast: integer }
      - { source: seg, target: seg, value_map: { BUILDING: B, MACHINERY: M }, value_map_fallback: "null" }
      - { source: code, target: note }
      - { source: seg, target: again }
      - { source: full_name, target: again }
  - { name: cards, source: cards, target: person, priority: 1, fields: [{ source: mail, target: mail }, { target: full, sources: [first, last], join: { sep: "#" }, split: { sep: "#", limit: 2 } }, { source: seg_code, target: seg, reverse_value_map: { M: "mach", B: "B" } }] }
"""
_PERSON = _with("people", "cards") + ", j AS (SELECT p.*, c.first, c.last, c.seg_code, c.id AS cid FROM people p LEFT JOIN cards c ON p.mail = c.mail)"


@query(
    _PERSON
    + """ SELECT mail, upper(left(full_name, 4)) || '-' || lpad(id, 8, '0') AS short, strftime(CAST(since AS DATE), '%d.%m.%Y') AS day, CAST(CAST(bal AS DECIMAL(12,1)) AS STRING) AS cents, replace(split_part(full_name, '#', 2), '0', '') AS letters, json_extract_string(extra, '$.phones[0].no') AS phone,
    CASE WHEN CAST(bal AS DECIMAL(18,4)) > 5000 THEN 'big' WHEN CAST(bal AS DECIMAL(18,4)) < 0 THEN 'debt' ELSE 'small' END AS size, CASE WHEN agreed IN ('true', 'false') THEN agreed END AS agreed, id AS whole FROM j"""
)
def computed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Expressions in the documents' dialect, and casts that give NULL where a value doesn't fit."""
    return pipeline(spark, d, FIELDS).record("person").select("mail", "short", "day", "cents", "letters", "phone", "size", "agreed", "whole")


@query(
    _PERSON
    + """ SELECT mail, CASE WHEN cid IS NOT NULL THEN first || '#' || last END AS "full", coalesce(seg_code, CASE seg WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END) AS seg, coalesce(code, 'none for ' || mail) AS note, 'basic' AS tier, seg AS again FROM j"""
)
def mapped_fields(spark: SparkSession, d: str) -> DataFrame:
    """Several columns as one, looked-up values, computed and literal defaults, and the first of two lines for one field."""
    return pipeline(spark, d, FIELDS).record("person").select("mail", "full", "seg", "note", "tier", "again")


@query(_PERSON + ", n AS (SELECT p.id, p.mail, CASE p.seg WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'mach' END AS s FROM j p WHERE cid IS NULL) SELECT mail, CAST(NULL AS STRING) AS first, CAST(NULL AS STRING) AS last, s AS seg_code FROM n")
def split_and_mapped_inserts(spark: SparkSession, d: str) -> DataFrame:
    """The same on the way back: split columns and reversed look-ups."""
    return pipeline(spark, d, FIELDS).deltas("cards").inserts.select("mail", "first", "last", "seg_code")


CURATED = """
version: "1.0"
sources: { people: { primary_key: id }, cards: { primary_key: id } }
targets: { person: { fields: { mail: { strategy: identity }, name: { strategy: coalesce }, n: { strategy: coalesce } } } }
mappings:
  - { name: people, source: people, target: person, priority: 1, filter: { and: [{ in: { field: seg, values: [BUILDING, MACHINERY, FURNITURE] } }, { not: { equals: { field: agreed, value: "yes" } } }, { or: [{ gt: { field: bal, value: 0 } }, { is_null: { field: code } }] }] }, fields: [{ source: mail, target: mail }, { source: full_name, target: name }, { source: id, target: n }] }
  - { name: cards, source: cards, target: person, priority: 2, reverse_filter: { and: [{ not_null: { field: name } }, { lte: { field: n, value: 900 } }] }, fields: [{ source: mail, target: mail }, { source: first, target: name, normalize: [trim, lowercase, { truncate: { length: 8 } }] }, { source: last, target: n, normalize: strip_non_digits }] }
"""
_CURATED = _with("people", "cards") + ", p AS (SELECT * FROM people WHERE seg IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND agreed <> 'yes' AND (CAST(bal AS DECIMAL(18,4)) > 0 OR code IS NULL))"


@query(_CURATED + " SELECT p.mail, full_name AS first, p.id AS last FROM p LEFT JOIN cards c ON p.mail = c.mail WHERE c.id IS NULL AND CAST(p.id AS BIGINT) <= 900")
def curated_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Curated predicates on both ways."""
    return pipeline(spark, d, CURATED).deltas("cards").inserts.select("mail", "first", "last")


@query(_CURATED + " SELECT c.id, CASE WHEN CAST(c.last AS BIGINT) <= 900 THEN 'noop' ELSE 'delete' END AS status FROM cards c")
def curated_noops(spark: SparkSession, d: str) -> DataFrame:
    """Curated normalisers: a shortened name is no difference; what fails the filter is a delete."""
    return pipeline(spark, d, CURATED).sync_status("cards").where("_src_pk is not null").select(F.col("_src_pk").alias("id"), "status")


NULLS = """
version: "1.0"
sources: { people: { primary_key: id }, cards: { primary_key: id } }
targets: { person: { fields: { mail: { strategy: identity }, code: { strategy: coalesce }, seg: { strategy: last_modified } } } }
mappings:
  - { name: people, source: people, target: person, fields: [{ source: mail, target: mail }, { source: code, target: code, priority: 2 }, { source: seg, target: seg, last_modified: since }] }
  - { name: cards, source: cards, target: person, fields: [{ source: mail, target: mail }, { source: seg_code, target: code, priority: 1, null_wins: true }, { source: seg_code, target: seg, last_modified: { min: from_day, max: to_day } }] }
"""


@query(
    _with("people", "cards")
    + """ SELECT p.mail, CASE WHEN c.id IS NULL THEN p.code ELSE c.seg_code END AS code, CASE WHEN c.seg_code IS NOT NULL AND greatest(from_day, to_day) > since THEN c.seg_code ELSE p.seg END AS seg FROM people p LEFT JOIN cards c ON p.mail = c.mail"""
)
def null_wins_and_time_ranges(spark: SparkSession, d: str) -> DataFrame:
    """An explicit NULL that beats values, and the later end of a time range."""
    return pipeline(spark, d, NULLS).record("person").select("mail", "code", "seg")


# references

KEPT = """
version: "1.0"
sources: { firms: { primary_key: id }, staff: { primary_key: id } }
targets:
  firm: { fields: { id: { strategy: identity }, web: { strategy: identity }, title: { strategy: coalesce } } }
  man: { fields: { mail: { strategy: identity }, firm: { strategy: coalesce, references: firm } } }
mappings:
  - { name: firms, source: firms, target: firm, fields: [{ source: id, target: id }, { source: web, target: web }, { source: title, target: title }] }
  - { name: staff, source: staff, target: man, fields: [{ source: mail, target: mail }, { source: firm_id, target: firm, references: firms }] }
"""


@query(_with("firms", "staff") + ", r AS (SELECT id, 'firms:' || min(id) OVER (PARTITION BY web) AS root FROM firms) SELECT s.id, s.firm_id, r.root AS firm, 'noop' AS status FROM staff s JOIN r ON s.firm_id = r.id")
def kept_references(spark: SparkSession, d: str) -> DataFrame:
    """A row keeps its own key of a merged entity."""
    pipe = pipeline(spark, d, KEPT)
    firm = pipe.golden("man").select(F.col("__id").alias("i"), F.col("e_firm").alias("firm"))
    noops = pipe.deltas("staff").noops.join(firm, F.col("_canonical_id") == F.col("i"))
    return noops.select("id", "firm_id", "firm", F.lit("noop").alias("status"))


VOCABULARY = """
version: "1.0"
sources: { lands: { primary_key: name }, coded: { primary_key: id }, spelled: { primary_key: id } }
targets:
  land: { fields: { name: { strategy: identity }, iso: { strategy: identity } } }
  client: { fields: { mail: { strategy: identity }, land: { strategy: coalesce, references: land } } }
mappings:
  - { name: lands, source: lands, target: land, fields: [{ source: name, target: name }, { source: iso, target: iso }] }
  - { name: coded, source: coded, target: client, fields: [{ source: mail, target: mail }, { source: code, target: land, references: lands, references_field: iso }] }
  - { name: spelled, source: spelled, target: client, fields: [{ source: mail, target: mail }, { source: land, target: land, references: lands, references_field: name }] }
"""


@query(_with("lands", "coded", "spelled") + " SELECT s.mail, l.iso AS code FROM spelled s LEFT JOIN coded c ON s.mail = c.mail LEFT JOIN lands l ON s.land = l.name WHERE c.id IS NULL")
def vocabulary_inserts(spark: SparkSession, d: str) -> DataFrame:
    """A name in one system is a code in another; a name that the vocabulary lacks stays open until it has it."""
    return pipeline(spark, d, VOCABULARY).deltas("coded").inserts.select("mail", "code")


COMPOSITE = """
version: "1.0"
sources: { heads: { primary_key: no }, tops: { primary_key: id }, items: { primary_key: [no, n] }, notes: { primary_key: id } }
targets:
  head: { fields: { ref: { strategy: identity } } }
  line: { fields: { head: { strategy: coalesce, references: head }, n: { strategy: coalesce }, good: { strategy: coalesce } } }
mappings:
  - { name: heads, source: heads, target: head, fields: [{ source: ref, target: ref }] }
  - { name: tops, source: tops, target: head, fields: [{ source: ref, target: ref }] }
  - { name: items, source: items, target: line, fields: [{ source: no, target: head, references: heads }, { source: n, target: n }, { source: good, target: good }] }
  - { name: notes, source: notes, target: line, fields: [{ source: top, target: head, references: tops }, { source: good, target: good }] }
"""


@query(_with("heads", "tops", "notes") + " SELECT 'notes:' || n.id AS canonical_id, h.no, CAST(NULL AS STRING) AS n, n.good FROM notes n LEFT JOIN tops t ON n.top = t.id LEFT JOIN heads h ON t.ref = h.ref")
def composite_key_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a key with two columns, one of them a reference, for entities without identity."""
    return _id(pipeline(spark, d, COMPOSITE).deltas("items").inserts).select("canonical_id", "no", "n", "good")


@query(_with("heads", "tops", "items") + """ SELECT 'items:{"n":"' || i.n || '","no":"' || i.no || '"}' AS canonical_id, CAST(NULL AS STRING) AS id, t.id AS top, i.good FROM items i JOIN heads h ON i.no = h.no LEFT JOIN tops t ON h.ref = t.ref""")
def deferred_reference_inserts(spark: SparkSession, d: str) -> DataFrame:
    """A reference to an entity that the system doesn't hold yet is NULL for now."""
    return _id(pipeline(spark, d, COMPOSITE).deltas("notes").inserts).select("canonical_id", "id", "top", "good")


# links

LINKS = """
version: "1.0"
sources: { left_rows: { primary_key: id }, right_rows: { primary_key: id }, pairs: { primary_key: id } }
targets: { %s }
mappings: [%s]
"""
_SITE = ("site: { fields: { title: { strategy: coalesce } } }", "{ name: left_site, source: left_rows, target: site, priority: 1, fields: [{ source: title, target: title }] }, { name: right_site, source: right_rows, target: site, priority: 2, fields: [{ source: name, target: title }] }, { name: pairs, source: pairs, target: site, %s links: [{ field: a, references: left_site }, { field: b, references: right_site }] }")
_MERGE = (
    "client: { fields: { aid: { strategy: identity }, bid: { strategy: identity }, title: { strategy: coalesce } } }",
    "{ name: left_client, source: left_rows, target: client, priority: 1, fields: [{ source: id, target: aid }, { source: title, target: title }] }, { name: right_client, source: right_rows, target: client, priority: 2, fields: [{ source: id, target: bid }, { source: name, target: title }] }, { name: merged, source: pairs, target: client, fields: [{ source: a, target: aid }, { source: b, target: bid }] }",
)


def _clusters(pipe: Pipeline, target: str) -> DataFrame:
    return _id(pipe.provenance(target)).select("canonical_id", F.col("_mapping").alias("mapping"), F.col("_src_pk").alias("src_pk"))


_ENDS = _with("left_rows", "right_rows", "pairs") + ", r AS (SELECT '{l}' AS mapping, id AS src_pk, substr(id, 2) AS k FROM left_rows UNION ALL SELECT '{r}', id, substr(id, 2) FROM right_rows UNION ALL SELECT '{p}', id, substr(id, 2) FROM pairs)"


@query(_ENDS.replace("{l}", "left_site").replace("{r}", "right_site").replace("{p}", "pairs") + " SELECT min(mapping || ':' || src_pk) OVER (PARTITION BY CASE WHEN CAST(k AS BIGINT) % 5 = 2 THEN k ELSE mapping || src_pk END) AS canonical_id, mapping, src_pk FROM r")
def link_table_clusters(spark: SparkSession, d: str) -> DataFrame:
    """A table of links joins what shares no value."""
    return _clusters(pipeline(spark, d, LINKS % (_SITE[0], _SITE[1] % "")), "site")


@query(_ENDS.replace("{l}", "left_site").replace("{r}", "right_site").replace("{p}", "pairs") + " SELECT min(mapping || ':' || src_pk) OVER (PARTITION BY CASE WHEN CAST(k AS BIGINT) % 5 = 2 THEN 'g' || CAST(CAST(floor(CAST(k AS BIGINT) / 10.0) AS BIGINT) AS STRING) ELSE mapping || src_pk END) AS canonical_id, mapping, src_pk FROM r")
def link_key_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Links with a precomputed cluster: all rows of one key are one entity."""
    return _clusters(pipeline(spark, d, LINKS % (_SITE[0], _SITE[1] % "link_key: grp,")), "site")


@query(_ENDS.replace("{l}", "left_client").replace("{r}", "right_client").replace("{p}", "merged") + " SELECT min(mapping || ':' || src_pk) OVER (PARTITION BY CASE WHEN CAST(k AS BIGINT) % 5 = 2 THEN k ELSE mapping || src_pk END) AS canonical_id, mapping, src_pk FROM r")
def curated_merge_clusters(spark: SparkSession, d: str) -> DataFrame:
    """A table that holds nothing but pairs of keys merges clusters."""
    return _clusters(pipeline(spark, d, LINKS % _MERGE), "client")


@query(_with("right_rows") + " SELECT 'right_site:' || id AS canonical_id, name AS title FROM right_rows")
def no_identity(spark: SparkSession, d: str) -> DataFrame:
    """Without identity every row is an entity of its own."""
    text = 'version: "1.0"\nsources: { right_rows: { primary_key: id } }\ntargets: { site: { fields: { title: { strategy: coalesce } } } }\nmappings: [{ name: right_site, source: right_rows, target: site, fields: [{ source: name, target: title }] }]'
    return _id(pipeline(spark, d, text).record("site"))


@query(_with("left_rows") + " SELECT title, seg, sha256(title || chr(31) || seg) AS identity_hash FROM left_rows")
def identity_hash(spark: SparkSession, d: str) -> DataFrame:
    """An entity's hash, from the values of its identity alone."""
    text = 'version: "2.0"\nsources: { left_rows: { primary_key: id } }\ntargets: { site: { identity: [[title, seg]], fields: { title: { strategy: coalesce }, seg: { strategy: coalesce } } } }\nmappings: [{ name: left_site, source: left_rows, target: site, fields: [{ source: title, target: title }, { source: seg, target: seg }] }]'
    return pipeline(spark, d, text).record("site", hashed=True).select("title", "seg", F.col("_identity_hash").alias("identity_hash"))


# rows that hold several entities

EMBEDDED = """
version: "1.0"
sources: { flat: { primary_key: id }, book: { primary_key: id } }
targets: { shop: { fields: { web: { strategy: coalesce } } }, card: { fields: { mail: { strategy: identity }, name: { strategy: last_modified } } } }
mappings:
  - { name: flat, source: flat, target: shop, fields: [{ source: web, target: web }] }
  - { name: flat_card, parent: flat, target: card, fields: [{ source: who, target: name, last_modified: at }, { source: mail, target: mail }] }
  - { name: book, source: book, target: card, fields: [{ source: name, target: name, last_modified: at }, { source: mail, target: mail }] }
"""
_CARDS = _with("flat", "book") + ", j AS (SELECT f.id, f.web, f.who, coalesce(f.mail, b.mail) AS mail, b.id AS bid, CASE WHEN b.id IS NULL OR (f.id IS NOT NULL AND f.at > b.at) THEN f.who WHEN f.id IS NULL OR b.at > f.at THEN b.name ELSE f.who END AS name, b.name AS bname FROM flat f FULL OUTER JOIN book b ON f.mail = b.mail)"


@query(_CARDS + " SELECT id, web, name AS who, mail FROM j WHERE id IS NOT NULL AND name <> who")
def embedded_updates(spark: SparkSession, d: str) -> DataFrame:
    """A part of a row is an entity of another target, and comes back in that row."""
    return pipeline(spark, d, EMBEDDED).deltas("flat").updates.select("id", "web", "who", "mail")


@query(_CARDS + " SELECT CASE WHEN id IS NULL THEN 'none' WHEN name <> who THEN 'update' ELSE 'noop' END AS status, count(*) AS n FROM j GROUP BY 1")
def embedded_without_inserts(spark: SparkSession, d: str) -> DataFrame:
    """What is only part of a row is never inserted."""
    return pipeline(spark, d, EMBEDDED).sync_status("flat_card").groupBy("status").agg(F.count("*").alias("n"))


# fields from other targets

COMPUTED = """
version: "1.0"
sources: { buyers: { primary_key: id }, sales: { primary_key: id } }
targets:
  man: { fields: { mid: { strategy: identity }, name: { strategy: coalesce }, %s } }
  sale: { fields: { sid: { strategy: identity }, sum: { strategy: coalesce, type: numeric }, man: { strategy: coalesce, references: man }, who: { strategy: coalesce } } }
mappings:
  - { name: buyers, source: buyers, target: man, fields: [{ source: id, target: mid }, { source: name, target: name }] }
  - { name: sales, source: sales, target: sale, fields: [{ source: id, target: sid }, { source: sum, target: sum }, { source: buyer, target: man, references: buyers }, { source: buyer, target: who }] }
"""
_SUMS = _with("buyers", "sales") + ", s AS (SELECT buyer, count(*) AS n, max(CAST(sum AS BIGINT)) AS best, sum(CAST(sum AS BIGINT)) AS total FROM sales GROUP BY buyer)"


@query(_SUMS + " SELECT id AS mid, CAST(coalesce(n, 0) AS STRING) AS n, CAST(best AS STRING) AS best FROM buyers LEFT JOIN s ON id = buyer")
def computed_from_match(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates over another target's entities with equal fields; over none, what the aggregate gives for no rows."""
    fields = 'n: { strategy: expression, expression: "count(*)", from: sale, match: { who: mid }, type: numeric }, best: { strategy: expression, expression: "max(sum::integer)", from: sale, match: { who: mid }, type: numeric }'
    return pipeline(spark, d, COMPUTED % fields).record("man").select("mid", "n", "best")


@query(_SUMS + " SELECT id AS mid, CAST(coalesce(total, 0) AS STRING) AS total, CASE WHEN n > 10 THEN name || ' buys' ELSE 'rare' END AS word FROM buyers LEFT JOIN s ON id = buyer")
def computed_dotted(spark: SparkSession, d: str) -> DataFrame:
    """Expressions over the fields of the entities that refer to this one."""
    fields = 'total: { strategy: expression, expression: "COALESCE(sum(sale.sum::integer), 0)", type: numeric }, word: { strategy: expression, expression: "CASE WHEN count(sale.sid) > 10 THEN name || \' buys\' ELSE \'rare\' END" }'
    return pipeline(spark, d, COMPUTED % fields).record("man").select("mid", "total", "word")


@query(_SUMS + " SELECT id AS mid, CAST(coalesce(n, 0) AS STRING) AS n FROM buyers LEFT JOIN s ON id = buyer")
def computed_query(spark: SparkSession, d: str) -> DataFrame:
    """A subquery over another target."""
    fields = 'n: { strategy: expression, type: numeric, expression: "COALESCE((SELECT count(*) FROM sale s WHERE s.who = man.mid), 0)" }'
    return pipeline(spark, d, COMPUTED % fields).record("man").select("mid", "n")


# outputs

GATES = """
version: "1.0"
output: { _canonical_id: entity, _action: what, _base: before, _requires_confirmation: ask }
sources: { kinds: { primary_key: id }, sink: { primary_key: id } }
targets:
  client: { fields: { mail: { strategy: identity }, kind: { strategy: coalesce, hierarchy: { "gold vip": vip, vip: customer, plain: customer } }, name: { strategy: coalesce }, address: { strategy: coalesce } } }
mappings:
  - { name: kinds, source: kinds, target: client, priority: 1, passthrough: [region], fields: [{ source: mail, target: mail }, { source: kind, target: kind }, { source: name, target: name }, { source: region, target_path: address.region }, { source: name, target_path: address.line.name, direction: forward_only }] }
  - { name: sink, source: sink, target: client, priority: 2, include_base: true, reverse_filter: "kind = 'customer' OR kind IN ('lead')", confirm: { delete: true }, confirm_when: "kind = 'lead'", fields: [{ source: mail, target: mail }, { source: name, target: name, confirm: true }] }
"""
_GATES = _with("kinds", "sink") + ", j AS (SELECT k.mail, k.kind, k.name, k.region, s.id, s.name AS sname, k.id AS kid FROM kinds k LEFT JOIN sink s ON k.mail = s.mail)"


@query(
    _GATES
    + """, p AS (SELECT *, kind <> 'buyer' AS pass FROM j) SELECT CASE WHEN id IS NULL THEN 'insert' WHEN NOT pass THEN 'delete' ELSE 'update' END AS what, 'kinds:' || kid AS entity, id, CASE WHEN id IS NULL THEN NULL ELSE '{"mail":"' || mail || '","name":"' || sname || '","id":"' || id || '"}' END AS before,
    TRUE AS ask FROM p WHERE (id IS NULL AND pass) OR (id IS NOT NULL AND (NOT pass OR sname <> name))"""
)
def gated_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchies in filters, gates for confirmation, the row as it was, and output columns with names of their own."""
    return pipeline(spark, d, GATES).deltas("sink").changes().select("what", "entity", "id", "before", "ask")


@query(_GATES + " SELECT count(*) AS n, CAST(sum(CASE WHEN kind = 'lead' THEN 1 ELSE 0 END) AS BIGINT) AS asked FROM j WHERE id IS NOT NULL AND kind <> 'buyer' AND sname = name")
def gated_noops(spark: SparkSession, d: str) -> DataFrame:
    """What changes nothing needs no confirmation: the rule holds for as many noops, and none asks."""
    pipe = pipeline(spark, d, GATES)
    kind = pipe.record("client").select("entity", "kind")
    rows = pipe.deltas("sink").noops.join(kind, "entity")
    return rows.agg(F.count("*").alias("n"), (F.count_if(F.col("kind") == "lead") + F.count_if("ask") * 1000000).alias("asked"))


@query(_GATES + " SELECT mail, region, name AS line_name FROM j")
def composite_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Several lines that make up one structured field."""
    return pipeline(spark, d, GATES).record("client").select("mail", F.col("address.region").alias("region"), F.col("address.line.name").alias("line_name"))


@query(_plain(f"SELECT {_KEY} AS `order`, c_name || ' !' AS `Contact Name`, {_MAIL} AS `e-mail`, c_mktsegment AS `_mapping` FROM {{customer}}"))
def quoted_columns(spark: SparkSession, d: str) -> DataFrame:
    """Source columns may be called anything."""
    text = """
version: "1.0"
sources: { odd: { primary_key: order }, wish: { primary_key: k } }
targets: { t: { fields: { mail: { strategy: identity }, name: { strategy: coalesce } } } }
mappings:
  - { name: odd, source: odd, target: t, priority: 2, passthrough: [_mapping], fields: [{ source: e-mail, target: mail }, { source: Contact Name, target: name }] }
  - { name: wish, source: wish, target: t, priority: 1, fields: [{ source: mail, target: mail }, { source: name, target: name }] }
"""
    wish = system(spark, d, f"SELECT 'k' || {_KEY} AS k, {_MAIL} AS mail, c_name || ' !' AS name FROM {{customer}}")
    return pipeline(spark, d, text, {"wish": wish}).deltas("odd").updates.select("order", "Contact Name", "e-mail", "_mapping")


LISTS = """
version: "1.0"
sources: { one: { primary_key: id }, two: { primary_key: id } }
targets: { t: { fields: { mail: { strategy: identity }, tags: { strategy: collect, element_type: text }, sizes: { strategy: coalesce, type: "numeric[]" } } } }
mappings:
  - { name: one, source: one, target: t, priority: 1, fields: [{ source: mail, target: mail }, { source: tags, target: tags, direction: forward_only }, { source: sizes, target: sizes }] }
  - { name: two, source: two, target: t, priority: 2, fields: [{ source: mail, target: mail }, { source: labels, target: tags, direction: forward_only }, { source: sizes, target: sizes }] }
"""


@query(
    f"""WITH c AS (SELECT {_MAIL} AS mail, c_custkey AS k, c_mktsegment AS seg FROM customer)
    SELECT mail, array_to_string(list_sort(list_distinct([seg, 'c' || CAST(k % 5 AS STRING)] || CASE WHEN k % 2 = 0 THEN ['x' || CAST(k % 3 AS STRING), seg] ELSE [] END)), ',') AS tags, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 9 WHEN k % 3 = 0 THEN NULL ELSE k % 10 + 2 END AS total FROM c"""
)
def array_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that hold arrays: united from all systems, or taken whole from the best."""
    one = system(spark, d, f"SELECT {_KEY} AS id, {_MAIL} AS mail, array(c_mktsegment, 'c' || CAST(c_custkey % 5 AS STRING)) AS tags, CASE WHEN c_custkey % 3 <> 0 THEN array(c_custkey % 10, 2L) END AS sizes FROM {{customer}}")
    two = system(spark, d, f"SELECT 'T' || {_KEY} AS id, {_MAIL} AS mail, to_json(array('x' || CAST(c_custkey % 3 AS STRING), c_mktsegment)) AS labels, '[4,5]' AS sizes FROM {{customer}} WHERE c_custkey % 2 = 0")
    out = pipeline(spark, d, LISTS, {"one": one, "two": two}).record("t")
    total = F.aggregate("sizes", F.lit(0).cast("decimal(38,18)"), lambda a, x: (a + x).cast("decimal(38,18)"))
    return out.select("mail", F.array_join("tags", ",").alias("tags"), total.cast("long").alias("total"))


# arrays

def orders_with_lines(spark: SparkSession, d: str, void: bool = False) -> DataFrame:
    """Orders of every eighth key, their lines (or, ``void``, with a mark on every fourth) nested."""
    rows = system(spark, d, NUMBERED).where("cast(order_id as bigint) % 8 < 4")
    fields = [F.col("line_key"), "part", "qty"] + ([F.when(F.col("line_key") % 4 == 0, "2024-02-03").alias("void")] if void else [])
    lists = rows.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("lines"))
    return system(spark, d, "SELECT CAST(o_orderkey AS STRING) AS order_id, CAST(o_custkey AS STRING) AS buyer FROM {orders} WHERE o_orderkey % 8 < 4").join(lists, "order_id", "left")


SHELF = """
version: "1.0"
sources: { shop: { primary_key: order_id }, shelf: { primary_key: order_id } }
targets:
  sale: { fields: { ref: { strategy: identity } } }
  line: { fields: { sale: { strategy: identity, references: sale, link_group: k }, key: { strategy: identity, type: numeric, link_group: k }, part: { strategy: coalesce }, qty: { strategy: coalesce, type: numeric }, before: { strategy: coalesce }, after: { strategy: coalesce } } }
mappings:
  - { name: shop, source: shop, target: sale, %s fields: [{ source: order_id, target: ref }] }
  - { name: shop_lines, parent: shop, array: lines, parent_fields: { up: order_id }, target: line, %s fields: [{ source: up, target: sale, references: shop }, { source: line_key, target: key }, { source: part, target: part }, { source: qty, target: qty } %s] }
  - { name: shelf, source: shelf, target: sale, fields: [{ source: order_id, target: ref }] }
  - { name: shelf_lines, parent: shelf, array: goods, parent_fields: { up: order_id }, target: line, %s fields: [{ source: up, target: sale, references: shelf }, { source: line_key, target: key }, { source: part, target: part }, { source: qty, target: qty } %s] }
"""
_NUMBERED = f"WITH b AS (SELECT * FROM ({_plain(NUMBERED)}) WHERE CAST(order_id AS BIGINT) % 8 < 4)"
_TEXT = "string_agg(line_key || ':' || part || ':' || qty, '|' ORDER BY {order})"


def _shelf(spark: SparkSession, d: str, shop: str = "", lines: str = "", more: str = "", shelf: str = "", shelf_more: str = "", void: bool = False, state: dict[str, DataFrame] | None = None) -> Pipeline:
    orders = orders_with_lines(spark, d, void)
    empty = orders.select("order_id", F.lit("[]").alias("goods"))
    return pipeline(spark, d, SHELF % (shop, lines, more, shelf, shelf_more), {"shop": orders, "shelf": empty}, state)


def _goods(df: DataFrame) -> DataFrame:
    parts = F.transform(F.from_json("goods", "array<struct<line_key:int,part:string,qty:int>>"), lambda x: F.concat_ws(":", x["line_key"].cast("string"), x["part"], x["qty"].cast("string")))
    return df.select("order_id", F.array_join(parts, "|").alias("goods"))


@query(_NUMBERED + f" SELECT order_id, {_TEXT.format(order='part DESC, line_key')} AS goods FROM b GROUP BY order_id")
def array_sorted_desc(spark: SparkSession, d: str) -> DataFrame:
    """Elements in descending order of a text, a beginning of another text after it."""
    return _goods(_shelf(spark, d, shelf="sort: [{ field: part, direction: desc }],").deltas("shelf").updates)


@query(_NUMBERED + f" SELECT order_id, {_TEXT.format(order='qty DESC, line_key')} AS goods FROM b GROUP BY order_id")
def array_sorted_numeric(spark: SparkSession, d: str) -> DataFrame:
    """Elements in descending order of a number."""
    return _goods(_shelf(spark, d, shelf="sort: [{ field: qty, direction: desc }],").deltas("shelf").updates)


@query(_NUMBERED + f" SELECT order_id, {_TEXT.format(order='line_key DESC')} AS goods FROM b GROUP BY order_id")
def element_chain(spark: SparkSession, d: str) -> DataFrame:
    """Elements in the order that the links to their neighbours say, against that of their keys."""
    links = ", { target: before, order_prev: true }, { target: after, order_next: true }"
    orders = orders_with_lines(spark, d).withColumn("lines", F.reverse("lines"))
    # the shelf has no order of its own: only the resolved neighbours give it one
    empty = orders.select("order_id", F.lit("[]").alias("goods"))
    return _goods(pipeline(spark, d, SHELF % ("", "", links, "", links), {"shop": orders, "shelf": empty}).deltas("shelf").updates)


@query(_NUMBERED + f" SELECT order_id, {_TEXT.format(order='line_key')} AS goods FROM b WHERE line_key % 4 <> 0 GROUP BY order_id")
def element_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    """An element that one system voids vanishes from every system's array."""
    return _goods(_shelf(spark, d, lines="soft_delete: void,", void=True).deltas("shelf").updates)


@query(
    _NUMBERED
    + """, w AS (SELECT order_id, line_key FROM b WHERE line_key <> 2 UNION ALL SELECT DISTINCT order_id, 99 FROM b)
    SELECT coalesce(b.order_id, w.order_id) AS order_id, CAST(coalesce(b.line_key, w.line_key) AS STRING) AS line_key, CASE WHEN w.order_id IS NULL THEN 'insert' WHEN b.order_id IS NULL THEN 'delete' ELSE 'present' END AS act FROM b FULL OUTER JOIN w ON b.order_id = w.order_id AND b.line_key = w.line_key"""
)
def element_actions(spark: SparkSession, d: str) -> DataFrame:
    """Elements against what their parent last wrote: new, still there, gone."""
    rows = system(spark, d, NUMBERED).where("cast(order_id as bigint) % 8 < 4")
    held = rows.where("line_key <> 2").select("order_id", "line_key").union(rows.select("order_id", F.lit(99)).distinct())
    written = held.groupBy("order_id").agg(F.to_json(F.struct(F.collect_list(F.struct("line_key")).alias("lines"))).alias("_written")).select(F.concat(F.lit("shop:"), "order_id").alias("_cluster_id"), "_written")
    out = _shelf(spark, d, shop="written_state: true,", state={"_written_shop": written}).element_deltas("shop_lines")
    return out.select(F.regexp_replace("_canonical_id", "^[a-z]+:", "").alias("order_id"), "line_key", F.col("_element_action").alias("act"))


TREE = """
version: "1.0"
sources: { tree: { primary_key: id }, twigs: { primary_key: tid } }
targets:
  root: { fields: { rid: { strategy: identity }, name: { strategy: coalesce } } }
  bough: { fields: { bid: { strategy: identity, type: numeric }, root: { strategy: coalesce, references: root }, size: { strategy: coalesce } } }
  twig: { fields: { tid: { strategy: identity, type: numeric }, bough: { strategy: coalesce, references: bough }, root: { strategy: coalesce, references: root }, leaf: { strategy: last_modified } } }
mappings:
  - { name: roots, source: tree, target: root, fields: [{ source: id, target: rid }, { source: name, target: name }] }
  - { name: boughs, parent: roots, array: boughs, parent_fields: { up: id }, target: bough, fields: [{ source: bid, target: bid }, { source: up, target: root, references: roots }, { source: size, target: size }] }
  - { name: tree_twigs, parent: boughs, array: twigs, last_modified: up_at, parent_fields: { up_bough: bid, up_root: { path: boughs, field: id }, up_at: { path: boughs, field: at } }, target: twig, fields: [{ source: tid, target: tid }, { source: up_bough, target: bough, references: boughs }, { source: up_root, target: root, references: roots }, { source: leaf, target: leaf }] }
  - { name: twigs, source: twigs, target: twig, fields: [{ source: tid, target: tid }, { source: leaf, target: leaf, last_modified: at }] }
"""
_TREE = """WITH t AS (SELECT r_regionkey AS rid, r_name AS rname, n_nationkey AS bid, n_name AS size, c_custkey AS tid, c_mktsegment AS leaf, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS tpos FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  p AS (SELECT n_nationkey AS nk, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS bpos FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)),
  x AS (SELECT t.*, bpos FROM t JOIN p ON bid = nk)"""


def tree(spark: SparkSession, d: str, native: bool = True) -> DataFrame:
    """Regions with their nations, and these with their customers: arrays of arrays, or as JSON text."""
    rows = system(spark, d, "SELECT r_regionkey AS rk, r_name AS name, n_nationkey AS bid, n_name AS size, c_custkey AS tid, c_mktsegment AS leaf FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey")
    boughs = rows.groupBy("rk", "name", "bid", "size").agg(F.array_sort(F.collect_list(F.struct("tid", "leaf"))).alias("twigs"))
    out = boughs.groupBy(F.col("rk").cast("string").alias("id"), "name").agg(F.array_sort(F.collect_list(F.struct("bid", "size", "twigs"))).alias("boughs")).withColumn("at", F.lit("2024-02-01"))
    return out if native else out.withColumn("boughs", F.to_json("boughs"))


_TWIGS = "SELECT CAST(c_custkey AS STRING) AS tid, lower(c_mktsegment) AS leaf, CASE WHEN c_custkey % 20 = 0 THEN '2024-03-01' ELSE '2024-01-01' END AS at FROM {customer} WHERE c_custkey % 10 = 0"


def _deep(native: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = pipeline(spark, d, TREE, {"tree": tree(spark, d, native), "twigs": system(spark, d, _TWIGS)}).forward("tree_twigs")
        return out.select(F.col("__pk").alias("row_pk"), F.col("__pos").alias("pos"), F.col("v_tid").alias("tid"), F.col("v_bough").alias("bough"), F.col("v_root").alias("root"), F.col("v_leaf").alias("leaf"), F.timestamp_micros("t_leaf").cast("date").cast("string").alias("at"))

    return run


QUERIES["deep_elements"], QUERIES["deep_elements_json"] = _deep(True), _deep(False)
ORACLE["deep_elements"] = ORACLE["deep_elements_json"] = _TREE + " SELECT rid || ':' || bpos || ':' || tpos AS row_pk, CAST(tpos AS INTEGER) AS pos, CAST(tid AS STRING) AS tid, CAST(bid AS STRING) AS bough, CAST(rid AS STRING) AS root, leaf, '2024-02-01' AS at FROM x"


@query(
    _TREE
    + """, n AS (SELECT rid, rname, bid, size, tid, CASE WHEN tid % 20 = 0 THEN lower(leaf) ELSE leaf END AS leaf FROM x), b AS (SELECT rid, rname, bid, size || '(' || string_agg(tid || ':' || leaf, ',' ORDER BY tid) || ')' AS bough, bool_or(leaf <> upper(leaf)) AS changed FROM n GROUP BY rid, rname, bid, size)
    SELECT CAST(rid AS STRING) AS id, rname AS name, string_agg(bough, ';' ORDER BY bid) AS boughs FROM b GROUP BY rid, rname HAVING bool_or(changed)"""
)
def deep_updates(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of arrays, put together again from the inside out."""
    out = pipeline(spark, d, TREE, {"tree": tree(spark, d), "twigs": system(spark, d, _TWIGS)}).deltas("roots").updates
    inner = lambda b: F.concat(b["size"], F.lit("("), F.array_join(F.transform(b["twigs"], lambda t: F.concat_ws(":", t["tid"].cast("string"), t["leaf"])), ","), F.lit(")"))
    return out.select("id", "name", F.array_join(F.transform(F.from_json("boughs", "array<struct<bid:int,size:string,twigs:array<struct<tid:int,leaf:string>>>>"), inner), ";").alias("boughs"))


@query(_TREE + " SELECT CAST(tid AS STRING) AS tid, CAST(bid AS STRING) AS bough, CAST(rid AS STRING) AS root, leaf FROM x")
def array_path(spark: SparkSession, d: str) -> DataFrame:
    """Elements at a path through two arrays, with fields of the levels above."""
    text = """
version: "1.0"
sources: { tree: { primary_key: id } }
targets: { root: { fields: { rid: { strategy: identity } } }, leaf: { fields: { tid: { strategy: identity }, bough: { strategy: coalesce }, root: { strategy: coalesce, references: root }, leaf: { strategy: coalesce } } } }
mappings:
  - { name: roots, source: tree, target: root, fields: [{ source: id, target: rid }] }
  - { name: leaves, parent: roots, array_path: boughs.twigs, parent_fields: { up: id }, target: leaf, fields: [{ source: tid, target: tid }, { source: up, target: root, references: roots }, { source: leaf, target: leaf }, { target: bough, expression: "split_part(mark, ':', 1)" }, { source: mark, direction: reverse_only }] }
"""
    # the path's own elements carry their bough in a mark
    marked = tree(spark, d).withColumn("boughs", F.transform("boughs", lambda b: F.struct(F.transform(b["twigs"], lambda t: F.struct(t["tid"].alias("tid"), t["leaf"].alias("leaf"), F.concat_ws(":", b["bid"].cast("string"), F.lit("b")).alias("mark"))).alias("twigs"))))
    return pipeline(spark, d, text, {"tree": marked}).record("leaf").select("tid", "bough", "root", "leaf")


@query(
    f"""WITH c AS (SELECT {_KEY} AS id, {_MAIL} AS mail, c_custkey AS k, c_mktsegment AS seg FROM customer), t AS (SELECT *, list_distinct([seg, 'c' || CAST(k % 5 AS STRING)]) AS tags, ['x' || CAST(k % 3 AS STRING), seg] AS labels FROM c), u AS (SELECT *, list_sort(list_distinct(tags || labels)) AS every FROM t WHERE k % 2 = 0)
    SELECT 'T' || id AS id, array_to_string(every, ',') AS labels FROM u WHERE every <> labels"""
)
def scalar_elements(spark: SparkSession, d: str) -> DataFrame:
    """Bare elements of two systems, one an array and one JSON text, united in order."""
    text = """
version: "1.0"
sources: { one: { primary_key: id }, two: { primary_key: id } }
targets: { man: { fields: { mail: { strategy: identity } } }, tag: { fields: { mail: { strategy: identity, link_group: k }, tag: { strategy: identity, link_group: k } } } }
mappings:
  - { name: one, source: one, target: man, fields: [{ source: mail, target: mail }] }
  - { name: one_tags, parent: one, array: tags, parent_fields: { up: mail }, target: tag, fields: [{ source: up, target: mail }, { target: tag, scalar: true }] }
  - { name: two, source: two, target: man, fields: [{ source: mail, target: mail }] }
  - { name: two_tags, parent: two, array: labels, parent_fields: { up: mail }, target: tag, fields: [{ source: up, target: mail }, { target: tag, scalar: true }] }
"""
    one = system(spark, d, f"SELECT {_KEY} AS id, {_MAIL} AS mail, array(c_mktsegment, 'c' || CAST(c_custkey % 5 AS STRING)) AS tags FROM {{customer}}")
    two = system(spark, d, f"SELECT 'T' || {_KEY} AS id, {_MAIL} AS mail, to_json(array('x' || CAST(c_custkey % 3 AS STRING), c_mktsegment)) AS labels FROM {{customer}} WHERE c_custkey % 2 = 0")
    out = pipeline(spark, d, text, {"one": one, "two": two}).deltas("two").updates
    return out.select("id", F.array_join(F.from_json("labels", "array<string>"), ",").alias("labels"))


# deletions

FLAGS = """
version: "1.0"
sources: { patrons: { primary_key: id }, guests: { primary_key: id } }
targets: { patron: { fields: { mail: { strategy: identity }, name: { strategy: coalesce }, gone: { strategy: bool_or, type: boolean } } } }
mappings:
  - { name: patrons, source: patrons, target: patron, soft_delete: { field: left_on, target: gone }, fields: [{ source: mail, target: mail }, { source: name, target: name, priority: 1 }] }
  - { name: guests, source: guests, target: patron, reverse_filter: "gone IS NOT TRUE", fields: [{ source: mail, target: mail }, { source: name, target: name, priority: 2 }] }
"""
_FLAGS = _with("patrons", "guests") + ", j AS (SELECT p.mail, p.name, p.left_on, g.id AS gid, g.name AS gname FROM patrons p LEFT JOIN guests g ON p.mail = g.mail)"


@query(_FLAGS + " SELECT mail, CASE WHEN left_on IS NULL THEN name ELSE gname END AS name, CASE WHEN left_on IS NULL THEN 'false' ELSE 'true' END AS gone FROM j")
def soft_delete_as_field(spark: SparkSession, d: str) -> DataFrame:
    """A soft delete that is a value of the entity; the row's other values no longer count."""
    return pipeline(spark, d, FLAGS).record("patron").select("mail", "name", "gone")


@query(_FLAGS + " SELECT gid AS id FROM j WHERE gid IS NOT NULL AND left_on IS NOT NULL")
def soft_delete_spreads(spark: SparkSession, d: str) -> DataFrame:
    """It deletes the entity's rows in a system that filters by it."""
    return pipeline(spark, d, FLAGS).deltas("guests").deletes.select("id")


NATURAL = """
version: "1.0"
sources: { lands: { primary_key: name }, spelled: { primary_key: id } }
targets: { land: { fields: { name: { strategy: identity }, iso: { strategy: coalesce } } } }
mappings:
  - { name: lands, source: lands, target: land, fields: [{ source: name, target: name }, { source: iso, target: iso }] }
  - { name: spelled, source: spelled, target: land, fields: [{ source: land, target: name }] }
"""


@query("SELECT 'ATLANTIS' AS name, CAST(NULL AS STRING) AS iso WHERE (SELECT count(*) FROM customer WHERE c_custkey % 30 IN (0, 20)) > 0")
def natural_key_inserts(spark: SparkSession, d: str) -> DataFrame:
    """A key that is an identity is known on insert; a surrogate isn't."""
    return pipeline(spark, d, NATURAL).deltas("lands").inserts.select("name", "iso")
