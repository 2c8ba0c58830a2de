"""Mapping documents over the driver's tables, and SQL that says what their results must be.

The systems are views of the tables, in SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.operators.intermediate import materialise
from goldweave.plans.model import parse
from goldweave.plans.pipeline import Pipeline

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Source systems; ``{table}`` is a table of the driver.
SYSTEMS = {
    "crm": """SELECT CAST(c_custkey AS STRING) AS id, 'c' || CAST(c_custkey AS STRING) || '@example.com' AS email, c_name AS name, c_mktsegment AS segment,
      'p' || CAST(CAST(floor(c_custkey / 2.0) AS BIGINT) AS STRING) AS phone, CAST(DATE '2024-01-01' + CAST(c_custkey % 97 AS INT) AS STRING) AS updated_at,
      CAST(c_nationkey AS STRING) AS nation, CASE WHEN c_custkey % 7 = 0 THEN 'firm' ELSE 'person' END AS kind, CASE WHEN c_custkey % 11 = 0 THEN '2024-05-01' END AS gone_at
      FROM {customer} WHERE c_custkey % 4 <> 3""",
    "erp": """SELECT 'E' || CAST(c_custkey AS STRING) AS id, 'c' || CAST(c_custkey AS STRING) || '@example.com' AS contact_email, CASE WHEN c_custkey % 6 = 1 THEN c_name ELSE upper(c_name) END AS contact_name,
      CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 9 = 4 THEN 'new ' || c_mktsegment ELSE c_mktsegment END AS seg, CAST(DATE '2024-01-01' + CAST((c_custkey * 7) % 97 AS INT) AS STRING) AS modified, 'N' || CAST(c_nationkey AS STRING) AS country,
      'r' || CAST(c_custkey % 3 AS STRING) AS region, CAST(c_custkey % 13 AS STRING) AS street, CAST(c_custkey % 17 AS STRING) AS zip
      FROM {customer} WHERE c_custkey % 4 <> 0""",
    "web": """SELECT 'W' || CAST(CAST(floor(c_custkey / 2.0) AS BIGINT) AS STRING) AS id, 'p' || CAST(CAST(floor(c_custkey / 2.0) AS BIGINT) AS STRING) AS phone,
      'web ' || CAST(CAST(floor(c_custkey / 2.0) AS BIGINT) AS STRING) AS display FROM {customer} WHERE c_custkey % 6 = 0""",
    "nations": "SELECT CAST(n_nationkey AS STRING) AS nk, n_name AS title FROM {nation}",
    "countries": "SELECT 'N' || CAST(n_nationkey AS STRING) AS code, n_name AS name FROM {nation}",
    "parts": "SELECT CAST(p_partkey AS STRING) AS pk, p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS STRING) AS size FROM {part}",
    "lines": """SELECT CAST(l_orderkey AS STRING) || '-' || CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS STRING) AS id, CAST(l_orderkey AS STRING) AS o, CAST(l_linenumber AS STRING) AS n,
      CAST(l_partkey AS STRING) AS part, CAST(CAST(l_quantity AS INT) AS STRING) AS qty FROM {lineitem}""",
    "logs": "SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS usr, event_type AS type, CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END AS bad, CAST(event_id % 1000 AS STRING) AS score, props AS doc FROM {events}",
}
#: Orders with their lines nested, the same lines in a flat system, both from one numbering.
NUMBERED = """SELECT CAST(l_orderkey AS STRING) AS order_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS INT) AS line_key,
  CAST(l_partkey AS STRING) AS part, CAST(l_quantity AS INT) AS qty FROM {lineitem}"""

CONTACT = """
version: "2.0"
sources: { crm: { primary_key: id }, erp: { primary_key: id } }
targets:
  contact:
    identity: [email]
    fields: { email: { strategy: coalesce }, name: { strategy: coalesce }, segment: { strategy: last_modified } }
mappings:
  - { name: crm, source: crm, target: contact, last_modified: updated_at, fields: [{ source: email, target: email }, { source: name, target: name, priority: 1 }, { source: segment, target: segment }] }
  - { name: erp, source: erp, target: contact, last_modified: modified, fields: [{ source: contact_email, target: email }, { source: contact_name, target: name, priority: 2 }, { source: seg, target: segment }] }
"""
GATED = """
version: "1.0"
sources: { crm: { primary_key: id }, erp: { primary_key: id } }
targets: { contact: { fields: { email: { strategy: identity }, name: { strategy: coalesce }, segment: { strategy: coalesce }, street: { strategy: coalesce, group: place }, zip: { strategy: coalesce, group: place }, status: { strategy: coalesce, default: open } } } }
mappings:
  - { name: crm, source: crm, target: contact, filter: "kind = 'person'", soft_delete: gone_at, fields: [{ source: email, target: email }, { source: name, target: name, priority: 1 }, { source: segment, target: segment, direction: forward_only }, { source: kind, direction: reverse_only, reverse_expression: "'person'" }] }
  - { name: erp, source: erp, target: contact, passthrough: [region], fields: [{ source: contact_email, target: email }, { source: contact_name, target: name, normalize: "upper(%s)" }, { source: seg, target: segment, reverse_required: true }, { source: street, target: street }, { source: zip, target: zip }] }
"""
CLOSURE = """
version: "1.0"
sources: { crm: { primary_key: id }, erp: { primary_key: id }, web: { primary_key: id } }
targets: { contact: { fields: { email: { strategy: identity }, phone: { strategy: identity }, name: { strategy: coalesce } } } }
mappings:
  - { name: crm, source: crm, target: contact, priority: 1, fields: [{ source: email, target: email }, { source: phone, target: phone }, { source: name, target: name }] }
  - { name: erp, source: erp, target: contact, priority: 2, fields: [{ source: contact_email, target: email }, { source: contact_name, target: name }] }
  - { name: web, source: web, target: contact, priority: 3, fields: [{ source: phone, target: phone }, { source: display, target: name }] }
"""
PLACES = """
version: "1.0"
sources: { crm: { primary_key: id }, erp: { primary_key: id }, nations: { primary_key: nk }, countries: { primary_key: code } }
targets:
  land: { fields: { title: { strategy: identity } } }
  contact: { fields: { email: { strategy: identity }, land: { strategy: coalesce, references: land } } }
mappings:
  - { name: nations, source: nations, target: land, fields: [{ source: title, target: title }] }
  - { name: countries, source: countries, target: land, fields: [{ source: name, target: title }] }
  - { name: crm, source: crm, target: contact, fields: [{ source: email, target: email }, { source: nation, target: land, references: nations }] }
  - { name: erp, source: erp, target: contact, fields: [{ source: contact_email, target: email }, { source: country, target: land, references: countries }] }
"""
STATE = """
version: "1.0"
sources: { crm: { primary_key: id }, erp: { primary_key: id } }
targets: { contact: { fields: { email: { strategy: identity }, name: { strategy: last_modified }, gone: { strategy: bool_or, type: boolean } } } }
mappings:
  - { name: crm, source: crm, target: contact, cluster_members: true, reverse_filter: "gone IS NOT TRUE", fields: [{ source: email, target: email }, { source: name, target: name, last_modified: updated_at }] }
  - { name: erp, source: erp, target: contact, cluster_members: true, derive_tombstones: gone, written_state: true, derive_noop: true, derive_timestamps: true, fields: [{ source: contact_email, target: email }, { source: contact_name, target: name }] }
"""
PARTS = """
version: "1.0"
sources: { parts: { primary_key: pk } }
targets:
  article:
    fields: { name: { strategy: identity }, brand: { strategy: coalesce }, types: { strategy: collect }, largest: { strategy: expression, expression: "max(largest::integer)", type: numeric }, n: { strategy: expression, expression: "count(brand)", type: numeric } }
mappings: [{ name: parts, source: parts, target: article, fields: [{ source: name, target: name }, { source: brand, target: brand }, { source: type, target: types, direction: forward_only }, { source: size, target: largest, direction: forward_only }] }]
"""
TUPLES = """
version: "2.0"
sources: { lines: { primary_key: id } }
targets: { line: { identity: [[o, n]], fields: { o: { strategy: coalesce }, n: { strategy: coalesce }, part: { strategy: coalesce }, qty: { strategy: coalesce } } } }
mappings: [{ name: lines, source: lines, target: line, fields: [{ source: o, target: o }, { source: n, target: n }, { source: part, target: part }, { source: qty, target: qty }] }]
"""
USERS = """
version: "1.0"
sources: { logs: { primary_key: id } }
targets:
  person:
    fields: { usr: { strategy: identity }, failed: { strategy: bool_or, type: boolean }, clean: { strategy: all_true, type: boolean }, kinds: { strategy: collect }, best: { strategy: expression, expression: "max(best::integer)", type: numeric }, k: { strategy: coalesce } }
mappings: [{ name: logs, source: logs, target: person, fields: [{ source: usr, target: usr }, { source: bad, target: failed }, { source: bad, target: clean }, { source: type, target: kinds }, { source: score, target: best }, { source_path: doc.k, target: k }] }]
"""
NESTED = """
version: "1.0"
sources: { shop: { primary_key: order_id }, wms: { primary_key: line_id } }
targets:
  sale: { fields: { ref: { strategy: identity }, buyer: { strategy: coalesce } } }
  line: { %s fields: { sale: { strategy: identity, references: sale, link_group: k }, key: { strategy: identity, type: numeric, link_group: k }, part: { strategy: coalesce }, qty: { strategy: coalesce, type: numeric }, pos: { strategy: coalesce }, before: { strategy: coalesce }, after: { strategy: coalesce } } }
mappings:
  - { name: shop, source: shop, target: sale, fields: [{ source: order_id, target: ref }, { source: buyer, target: buyer }] }
  - { name: shop_lines, parent: shop, array: lines, parent_fields: { up: order_id }, target: line, priority: 2, fields: [{ source: up, target: sale, references: shop }, { source: line_key, target: key }, { source: part, target: part }, { source: qty, target: qty }, { target: pos, order: true }, { target: before, order_prev: true }, { target: after, order_next: true }] }
  - { name: wms, source: wms, target: line, priority: 1, fields: [{ source: order_number, target: sale, references: shop }, { source: line_key, target: key }, { source: part, target: part }, { source: qty, target: qty }] }
"""


def system(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql})


def pipeline(spark: SparkSession, sf_dir: str, text: str, state: dict[str, str] | None = None) -> Pipeline:
    doc = parse(text)
    return Pipeline(doc, {n: system(spark, sf_dir, SYSTEMS[n]) for n in doc.sources}, {n: system(spark, sf_dir, q) for n, q in (state or {}).items()})


#: The flat system lacks every fifth line of an order, and of a third of the rest it has another quantity.
FLAT = "line_key % 5 <> 4"
FLAT_QTY = "CASE WHEN (CAST(order_id AS BIGINT) + line_key) % 3 = 1 THEN qty + 1 ELSE qty END"


def nested(spark: SparkSession, sf_dir: str, elements: str = "") -> Pipeline:
    """A shop whose orders hold their lines, and a warehouse with a row for each line; written down in several files, as the tables of real systems are."""
    rows = materialise(system(spark, sf_dir, NUMBERED), "numbered_lines")
    lists = rows.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("line_key", "part", "qty"))).alias("lines"))
    orders = system(spark, sf_dir, "SELECT CAST(o_orderkey AS STRING) AS order_id, CAST(o_custkey AS STRING) AS buyer FROM {orders}")
    flat = rows.where(FLAT).select(F.concat_ws("-", "order_id", "line_key").alias("line_id"), F.col("order_id").alias("order_number"), "line_key", "part", F.expr(FLAT_QTY).alias("qty"))
    return Pipeline(parse(NESTED % elements), {"shop": materialise(orders.repartition(spark.sparkContext.defaultParallelism).join(lists, "order_id", "left"), "shop"), "wms": flat})


def _state(spark: SparkSession, sf_dir: str) -> Pipeline:
    """ERP once held every customer; of those with a key divisible by 20 the row is gone."""
    doc = parse(STATE)
    erp = SYSTEMS["erp"] + " AND c_custkey % 20 <> 1"
    members = {
        "_cluster_members_crm": "SELECT 'k' || CAST(c_custkey AS STRING) AS _cluster_id, CAST(c_custkey AS STRING) AS _src_id FROM {customer} WHERE c_custkey % 4 <> 3",
        "_cluster_members_erp": "SELECT 'k' || CAST(c_custkey AS STRING) AS _cluster_id, 'E' || CAST(c_custkey AS STRING) AS _src_id FROM {customer} WHERE c_custkey % 4 <> 0",
        "_written_erp": """SELECT 'k' || CAST(c_custkey AS STRING) AS _cluster_id, '{"contact_email":"c' || CAST(c_custkey AS STRING) || '@example.com","contact_name":"' || CASE WHEN c_custkey % 3 = 0 THEN 'before' ELSE c_name END || '"}' AS _written,
           CASE WHEN c_custkey % 2 = 0 THEN '2024-01-31' ELSE '2023-06-01' END AS _written_at, '{"contact_name":"2023-01-01"}' AS _written_ts FROM {customer}""",
    }
    # braces of the JSON text must pass the formatter
    members["_written_erp"] = members["_written_erp"].replace("'{\"", "'{{\"").replace("\"}'", "\"}}'")
    return Pipeline(doc, {"crm": system(spark, sf_dir, SYSTEMS["crm"]), "erp": system(spark, sf_dir, erp)}, {n: system(spark, sf_dir, q) for n, q in members.items()})


def _id(df: DataFrame) -> DataFrame:
    """Without the leading underscore that marks an engine column."""
    return df.withColumnRenamed("_canonical_id", "canonical_id")


def _contact(kind: str, mapping: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _id(getattr(pipeline(spark, d, CONTACT).deltas(mapping), kind))


def contact_updates(spark: SparkSession, d: str) -> DataFrame:
    return _id(pipeline(spark, d, CONTACT).deltas("erp").updates)


def _lines_text(df: DataFrame, column: str = "lines") -> DataFrame:
    """An array of lines as one text, so that engines compare it alike."""
    kind = "array<struct<line_key:int,part:string,qty:int>>"
    parts = F.transform(F.from_json(column, kind), lambda x: F.concat_ws(":", x["line_key"].cast("string"), x["part"], x["qty"].cast("string")))
    return df.withColumn("lines_text", F.array_join(parts, "|"))


def _array_updates(elements: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _lines_text(nested(spark, d, elements).deltas("shop").updates).select("order_id", "buyer", "lines_text")

    return run


def element_positions(spark: SparkSession, d: str) -> DataFrame:
    g = nested(spark, d).golden("line")
    return g.where("v_pos is not null").select(F.col("__id").alias("canonical_id"), F.col("v_key").alias("line_key"), F.col("v_pos").alias("pos"), F.col("v_before").alias("before"), F.col("v_after").alias("after"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "forward_crm": lambda s, d: pipeline(s, d, CONTACT).forward("crm").select(F.col("__row").alias("row_id"), F.col("v_email").alias("email"), F.col("v_name").alias("name"), F.col("p_name").alias("name_priority"), F.timestamp_micros("t_segment").cast("date").cast("string").alias("changed")),
    "identified_contact": lambda s, d: _id(pipeline(s, d, CONTACT).provenance("contact")).select("canonical_id", F.col("_mapping").alias("mapping"), F.col("_src_pk").alias("src_pk")),
    "golden_contact": lambda s, d: _id(pipeline(s, d, CONTACT).record("contact")),
    "contact_updates": contact_updates,
    "contact_updates_crm": _contact("updates", "crm"),
    "contact_inserts_crm": _contact("inserts", "crm"),
    "contact_inserts_erp": _contact("inserts", "erp"),
    "contact_changes": lambda s, d: pipeline(s, d, CONTACT).deltas("erp").changes().groupBy(F.col("_action").alias("action")).agg(F.count("*").alias("n"), F.count("id").alias("with_id")),
    "contact_contributions": lambda s, d: _id(pipeline(s, d, CONTACT).contributed("contact")).select("canonical_id", "field", F.col("_mapping").alias("mapping"), "value", "wins"),
    "contact_sync_status": lambda s, d: pipeline(s, d, CONTACT).sync_status("erp").groupBy("status").agg(F.count("*").alias("n")),
    "gated_deletes": lambda s, d: _id(pipeline(s, d, GATED).deltas("erp").deletes).select("canonical_id", "id"),
    "gated_updates": lambda s, d: _id(pipeline(s, d, GATED).deltas("erp").updates).select("canonical_id", "id", "contact_name", "seg", "region"),
    "gated_inserts_crm": lambda s, d: _id(pipeline(s, d, GATED).deltas("crm").inserts),
    "gated_golden": lambda s, d: _id(pipeline(s, d, GATED).record("contact")),
    "closure_three_sources": lambda s, d: _id(pipeline(s, d, CLOSURE).provenance("contact")).select("canonical_id", F.col("_mapping").alias("mapping"), F.col("_src_pk").alias("src_pk")),
    "closure_updates_web": lambda s, d: _id(pipeline(s, d, CLOSURE).deltas("web").updates),
    "reference_updates": lambda s, d: _id(pipeline(s, d, PLACES).deltas("erp").inserts),
    "reference_golden": lambda s, d: pipeline(s, d, PLACES).golden("contact").select(F.col("__id").alias("canonical_id"), F.col("e_land").alias("land_id")),
    "tombstone_deletes": lambda s, d: _id(_state(s, d).deltas("crm").deletes).select("canonical_id", "id", "email"),
    "written_noops": lambda s, d: _id(_state(s, d).deltas("erp").noops).select("canonical_id", "id"),
    "derived_times_golden": lambda s, d: _state(s, d).golden("contact").select(F.col("__id").alias("canonical_id"), F.col("v_name").alias("name"), F.col("v_gone").alias("gone")),
    "merge_internal_golden": lambda s, d: _id(pipeline(s, d, PARTS).record("article")),
    "merge_internal_updates": lambda s, d: _id(pipeline(s, d, PARTS).deltas("parts").updates),
    "identity_tuple": lambda s, d: _id(pipeline(s, d, TUPLES).record("line")),
    "aggregate_strategies": lambda s, d: _id(pipeline(s, d, USERS).record("person")).select("usr", "failed", "clean", "kinds", "best", "k"),
    "child_explode_lines": lambda s, d: nested(s, d).forward("shop_lines").select(F.col("__pk").alias("row_pk"), F.col("__ppk").alias("order_id"), F.col("__pos").alias("ordinal"), F.col("v_key").alias("line_key"), F.col("v_part").alias("part"), F.col("v_qty").alias("qty")),
    "array_updates": _array_updates(""),
    "element_authority": _array_updates("elements: coalesce,"),
    "element_positions": element_positions,
}

_CTE = {n: f"{n} AS ({q.replace('{', '').replace('}', '')})" for n, q in SYSTEMS.items()}


def _with(*names: str) -> str:
    return "WITH " + ", ".join(_CTE[n] for n in names)


_BOTH = (
    _with("crm", "erp")
    + """, j AS (SELECT coalesce(c.email, e.contact_email) AS email, c.id AS cid, e.id AS eid, c.name AS cname, e.contact_name AS ename, c.segment AS cseg, e.seg AS eseg, c.updated_at AS cat, e.modified AS eat,
    CASE WHEN c.id IS NOT NULL THEN 'crm:' || c.id ELSE 'erp:' || e.id END AS canonical_id FROM crm c FULL OUTER JOIN erp e ON c.email = e.contact_email),
  g AS (SELECT *, coalesce(cname, ename) AS name, CASE WHEN cseg IS NULL THEN eseg WHEN eseg IS NULL THEN cseg WHEN eat > cat THEN eseg ELSE cseg END AS segment FROM j)"""
)
#: The gated document: CRM only persons, the soft-deleted ones don't count; a name that is the upper-case echo of CRM's loses.
_GATED = (
    _with("crm", "erp")
    + """, p AS (SELECT * FROM crm WHERE kind = 'person'),
  j AS (SELECT coalesce(c.email, e.contact_email) AS email, c.id AS cid, e.id AS eid, CASE WHEN c.gone_at IS NULL THEN c.name END AS cname, e.contact_name AS ename, CASE WHEN c.gone_at IS NULL THEN c.segment END AS cseg, e.seg AS eseg, c.gone_at,
    e.region, e.street, e.zip, CASE WHEN c.id IS NOT NULL THEN 'crm:' || c.id ELSE 'erp:' || e.id END AS canonical_id FROM p c FULL OUTER JOIN erp e ON c.email = e.contact_email),
  g AS (SELECT *, coalesce(cname, ename) AS name, coalesce(cseg, eseg) AS segment FROM j WHERE eid IS NOT NULL OR gone_at IS NULL)"""
)
_CLOSE = (
    _with("crm", "erp", "web")
    + """, r AS (SELECT 'crm' AS mapping, id AS src_pk, email, phone, name, 1 AS p FROM crm UNION ALL SELECT 'erp', id, contact_email, NULL, contact_name, 2 FROM erp UNION ALL SELECT 'web', id, NULL, phone, display, 3 FROM web),
  m AS (SELECT email, min(phone) AS phone FROM r WHERE email IS NOT NULL GROUP BY email),
  k AS (SELECT r.*, coalesce(r.phone, m.phone, r.email) AS grp FROM r LEFT JOIN m ON r.email = m.email),
  c AS (SELECT *, min(mapping || ':' || src_pk) OVER (PARTITION BY grp) AS canonical_id FROM k)"""
)
_NEST = f"""WITH b AS ({NUMBERED.replace("{", "").replace("}", "")}), w AS (SELECT order_id, line_key, part, {FLAT_QTY} AS qty FROM b WHERE {FLAT})"""
_TIMES = (
    _with("crm", "erp")
    + """, e0 AS (SELECT * FROM erp WHERE CAST(substr(id, 2) AS BIGINT) % 20 <> 1),
  j AS (SELECT coalesce(c.email, e.contact_email) AS email, c.id AS cid, e.id AS eid, c.name AS cname, e.contact_name AS ename, c.updated_at AS cat, CAST(coalesce(c.id, substr(e.id, 2)) AS BIGINT) AS key,
    CASE WHEN c.id IS NOT NULL THEN 'crm:' || c.id ELSE 'erp:' || e.id END AS base_id FROM crm c FULL OUTER JOIN e0 e ON c.email = e.contact_email),
  t AS (SELECT *, key % 4 <> 0 AND key % 20 = 1 AS ghost, CASE WHEN key % 3 = 0 THEN 'before' ELSE (SELECT c_name FROM customer WHERE c_custkey = key) END AS written FROM j),
  g AS (SELECT *, base_id AS canonical_id, CASE WHEN ename = written THEN '2023-01-01' WHEN key % 2 = 0 THEN '2024-01-31' ELSE '2023-06-01' END AS eat FROM t),
  n AS (SELECT *, CASE WHEN cname IS NULL THEN ename WHEN ename IS NULL THEN cname WHEN eat > cat THEN ename ELSE cname END AS name FROM g)"""
)

ORACLE: dict[str, str] = {
    "forward_crm": _with("crm") + " SELECT 'crm:' || id AS row_id, email, name, 1 AS name_priority, updated_at AS changed FROM crm",
    "identified_contact": _BOTH + " SELECT canonical_id, 'crm' AS mapping, cid AS src_pk FROM g WHERE cid IS NOT NULL UNION ALL SELECT canonical_id, 'erp', eid FROM g WHERE eid IS NOT NULL",
    "golden_contact": _BOTH + " SELECT canonical_id, email, name, segment FROM g",
    "contact_updates": _BOTH + " SELECT canonical_id, eid AS id, email AS contact_email, name AS contact_name, segment AS seg FROM g WHERE eid IS NOT NULL AND (name IS DISTINCT FROM ename OR segment IS DISTINCT FROM eseg)",
    "contact_updates_crm": _BOTH + " SELECT canonical_id, cid AS id, email, name, segment FROM g WHERE cid IS NOT NULL AND (name IS DISTINCT FROM cname OR segment IS DISTINCT FROM cseg)",
    "contact_inserts_crm": _BOTH + " SELECT canonical_id, CAST(NULL AS STRING) AS id, email, name, segment FROM g WHERE cid IS NULL",
    "contact_inserts_erp": _BOTH + " SELECT canonical_id, CAST(NULL AS STRING) AS id, email AS contact_email, name AS contact_name, segment AS seg FROM g WHERE eid IS NULL",
    "contact_changes": _BOTH + ", a AS (SELECT CASE WHEN eid IS NULL THEN 'insert' WHEN name IS DISTINCT FROM ename OR segment IS DISTINCT FROM eseg THEN 'update' END AS action, eid FROM g) SELECT action, count(*) AS n, count(eid) AS with_id FROM a WHERE action IS NOT NULL GROUP BY action",
    "contact_contributions": _BOTH
    + """ SELECT canonical_id, 'name' AS field, 'crm' AS mapping, cname AS value, cname = name AS wins FROM g WHERE cname IS NOT NULL UNION ALL SELECT canonical_id, 'name', 'erp', ename, ename = name FROM g WHERE ename IS NOT NULL
      UNION ALL SELECT canonical_id, 'segment', 'crm', cseg, cseg = segment FROM g WHERE cseg IS NOT NULL UNION ALL SELECT canonical_id, 'segment', 'erp', eseg, eseg = segment FROM g WHERE eseg IS NOT NULL
      UNION ALL SELECT canonical_id, 'email', 'crm', email, TRUE FROM g WHERE cid IS NOT NULL UNION ALL SELECT canonical_id, 'email', 'erp', email, TRUE FROM g WHERE eid IS NOT NULL""",
    "contact_sync_status": _BOTH + " SELECT CASE WHEN eid IS NULL THEN 'insert' WHEN name IS DISTINCT FROM ename OR segment IS DISTINCT FROM eseg THEN 'update' ELSE 'noop' END AS status, count(*) AS n FROM g GROUP BY 1",
    "gated_deletes": _GATED + " SELECT canonical_id, eid AS id FROM g WHERE eid IS NOT NULL AND segment IS NULL",
    "gated_updates": _GATED + " SELECT canonical_id, eid AS id, name AS contact_name, segment AS seg, region FROM g WHERE eid IS NOT NULL AND segment IS NOT NULL AND (upper(name) IS DISTINCT FROM upper(ename) OR segment IS DISTINCT FROM eseg)",
    "gated_inserts_crm": _GATED + " SELECT canonical_id, CAST(NULL AS STRING) AS id, email, name, 'person' AS kind FROM g WHERE cid IS NULL",
    "gated_golden": _GATED + " SELECT canonical_id, email, name, segment, street, zip, 'open' AS status FROM g",
    "closure_three_sources": _CLOSE + " SELECT canonical_id, mapping, src_pk FROM c",
    "closure_updates_web": _CLOSE + ", n AS (SELECT *, first_value(name) OVER (PARTITION BY canonical_id ORDER BY p, src_pk) AS best FROM c) SELECT canonical_id, src_pk AS id, phone, best AS display FROM n WHERE mapping = 'web' AND best <> name",
    "reference_updates": _BOTH.replace("e.modified AS eat,", "e.modified AS eat, c.nation AS cnation,") + " SELECT canonical_id, CAST(NULL AS STRING) AS id, email AS contact_email, 'N' || cnation AS country FROM g WHERE eid IS NULL",
    "reference_golden": _BOTH.replace("e.modified AS eat,", "e.modified AS eat, coalesce(c.nation, substr(e.country, 2)) AS nk,") + " SELECT canonical_id, 'countries:N' || nk AS land_id FROM g",
    "tombstone_deletes": _TIMES + " SELECT canonical_id, cid AS id, email FROM n WHERE cid IS NOT NULL AND ghost",
    "written_noops": _TIMES + " SELECT canonical_id, eid AS id FROM n WHERE eid IS NOT NULL AND (name = ename OR name = written)",
    "derived_times_golden": _TIMES + " SELECT canonical_id, name, CASE WHEN ghost THEN 'true' END AS gone FROM n UNION ALL SELECT 'erp:E' || CAST(c_custkey AS STRING), NULL, 'true' FROM customer WHERE c_custkey % 4 = 3 AND c_custkey % 20 = 1",
    "merge_internal_golden": _with("parts")
    + """ SELECT 'parts:' || min(pk) AS canonical_id, name, arg_min(brand, pk) AS brand, '["' || string_agg(DISTINCT type, '","' ORDER BY type) || '"]' AS types, CAST(max(CAST(size AS INT)) AS STRING) AS largest, CAST(count(*) AS STRING) AS n FROM parts GROUP BY name""",
    "merge_internal_updates": _with("parts") + ", g AS (SELECT *, first_value(brand) OVER (PARTITION BY name ORDER BY pk) AS best, min(pk) OVER (PARTITION BY name) AS root FROM parts) SELECT 'parts:' || root AS canonical_id, pk, name, best AS brand FROM g WHERE best <> brand",
    "identity_tuple": _with("lines") + " SELECT 'lines:' || min(id) AS canonical_id, o, n, arg_min(part, id) AS part, arg_min(qty, id) AS qty FROM lines GROUP BY o, n",
    "aggregate_strategies": _with("logs")
    + """ SELECT usr, CASE WHEN bool_or(bad = 'true') THEN 'true' ELSE 'false' END AS failed, CASE WHEN bool_and(bad = 'true') THEN 'true' ELSE 'false' END AS clean, '["' || string_agg(DISTINCT type, '","' ORDER BY type) || '"]' AS kinds,
      CAST(max(CAST(score AS INT)) AS STRING) AS best, arg_min(doc ->> '$.k', id) AS k FROM logs GROUP BY usr""",
    "child_explode_lines": _NEST + " SELECT order_id || ':' || CAST(line_key - 1 AS STRING) AS row_pk, order_id, line_key - 1 AS ordinal, CAST(line_key AS STRING) AS line_key, part, CAST(qty AS STRING) AS qty FROM b",
    "array_updates": _NEST
    + """, x AS (SELECT b.order_id, b.line_key, b.part, coalesce(w.qty, b.qty) AS qty, w.qty IS NOT NULL AND w.qty <> b.qty AS changed FROM b LEFT JOIN w ON b.order_id = w.order_id AND b.line_key = w.line_key)
      SELECT x.order_id, CAST(o_custkey AS STRING) AS buyer, string_agg(line_key || ':' || part || ':' || qty, '|' ORDER BY line_key) AS lines_text FROM x JOIN orders ON x.order_id = CAST(o_orderkey AS STRING) GROUP BY x.order_id, o_custkey HAVING bool_or(changed)""",
    "element_authority": _NEST
    + """, n AS (SELECT order_id, string_agg(line_key || ':' || part || ':' || qty, '|' ORDER BY line_key) AS lines_text FROM w GROUP BY order_id), o AS (SELECT order_id, string_agg(line_key || ':' || part || ':' || qty, '|' ORDER BY line_key) AS own FROM b GROUP BY order_id)
      SELECT n.order_id, CAST(o_custkey AS STRING) AS buyer, lines_text FROM n JOIN o ON n.order_id = o.order_id JOIN orders ON n.order_id = CAST(o_orderkey AS STRING) WHERE lines_text <> own""",
    "element_positions": _NEST
    + f""" SELECT CASE WHEN {FLAT} THEN least('shop_lines:' || order_id || ':' || CAST(line_key - 1 AS STRING), 'wms:' || order_id || '-' || CAST(line_key AS STRING)) ELSE 'shop_lines:' || order_id || ':' || CAST(line_key - 1 AS STRING) END AS canonical_id, CAST(line_key AS STRING) AS line_key, lpad(CAST(line_key - 1 AS STRING), 10, '0') AS pos,
      CAST(lag(line_key) OVER (PARTITION BY order_id ORDER BY line_key) AS STRING) AS before, CAST(lead(line_key) OVER (PARTITION BY order_id ORDER BY line_key) AS STRING) AS after FROM b""",
}
