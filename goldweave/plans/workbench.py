"""Queries over what surrounds a document: files, inline rows, keys, views, written tables, checks and streams."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.cli import describe
from goldweave.functions import expressions as X
from goldweave.operators.delta import TooManyChanges, guarded
from goldweave.operators.intermediate import shared_dir
from goldweave.plans import showcase
from goldweave.plans.golden import pipeline_of
from goldweave.plans.model import DocumentError, load, parse
from goldweave.plans.pipeline import NotUnique, Pipeline, assert_unique
from goldweave.sources.registry import decode_key, encode_key
from goldweave.streaming.refresh import ORDER, SOURCE, Snapshots, feed_back, refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/goldweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query(showcase.ORACLE["golden_contact"])
def document_in_files(spark: SparkSession, d: str) -> DataFrame:
    """A document in several files of a folder."""
    head, _, mappings = showcase.CONTACT.partition("mappings:")
    with tempfile.TemporaryDirectory() as folder:
        for name, text in (("a.yaml", head), ("deep/b.yml", 'version: "2.0"\nmappings:' + mappings)):
            os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
            with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
                f.write(text)
        doc = load(folder)
    return showcase._id(Pipeline(doc, {n: showcase.system(spark, d, showcase.SYSTEMS[n]) for n in doc.sources}).record("contact"))


@query("SELECT * FROM (VALUES ('a:1', 'p', 'x', '{\"k\":[1,2],\"m\":{\"z\":null}}'), ('b:7', 'q', 'w', NULL)) AS t(canonical_id, k, v, j)")
def inline_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as they stand in a document's tests: nested values are JSON, and an empty source has its columns."""
    text = """
version: "1.0"
sources: { a: { primary_key: id }, b: { primary_key: id }, c: { primary_key: id } }
targets: { t: { fields: { k: { strategy: identity }, v: { strategy: coalesce }, j: { strategy: coalesce, type: jsonb } } } }
mappings:
  - { name: a, source: a, target: t, fields: [{ source: k, target: k }, { source: v, target: v, priority: 1 }, { source: j, target: j }] }
  - { name: b, source: b, target: t, fields: [{ source: key, target: k }, { source: val, target: v, priority: 2 }] }
  - { name: c, source: c, target: t, fields: [{ source: none, target: v }] }
"""
    rows = {"a": [{"id": "1", "k": "p", "v": "x", "j": {"m": {"z": None}, "k": [1, 2]}}], "b": [{"id": 9, "key": "p", "val": "y"}, {"id": 7, "key": "q", "val": "w"}]}
    return showcase._id(pipeline_of(spark, parse(text), rows).record("t"))


@query("SELECT p_name || ' 50%/?+*~ü' AS name, replace(url_encode(p_name || ' 50%/?+*~ü'), '+', '%20') AS key, TRUE AS exact FROM part")
def row_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys as the last part of an address, and back."""
    rows = showcase.system(spark, d, "SELECT p_name || ' 50%/?+*~ü' AS name FROM {part}")
    return rows.withColumn("key", encode_key(F.col("name"))).withColumn("exact", decode_key(F.col("key")) == F.col("name"))


@query("SELECT * FROM (VALUES (0, 'target contact: identity (email)'), (1, '  email: coalesce'), (2, '  name: coalesce'), (3, '  segment: last_modified'), (4, '  <- crm: rows of crm; 3 fields'), (5, '  <- erp: rows of erp; 3 fields')) AS t(line, text)")
def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    """The stages of a document's plan in words."""
    return spark.createDataFrame(list(enumerate(describe(parse(showcase.CONTACT)).split("\n"))), "line int, text string")


@query(
    showcase._BOTH
    + """ SELECT 'contact' AS stage, count(*) AS n FROM g UNION ALL SELECT 'crm_forward', count(cid) FROM g UNION ALL SELECT 'contact_identified', count(cid) + count(eid) FROM g
    UNION ALL SELECT 'erp_inserts', count(*) FROM g WHERE eid IS NULL UNION ALL SELECT 'erp_updates', count(*) FROM g WHERE eid IS NOT NULL AND (name IS DISTINCT FROM ename OR segment IS DISTINCT FROM eseg)"""
)
def stage_views(spark: SparkSession, d: str) -> DataFrame:
    """A view for every stage."""
    prefix = "stage_" + uuid.uuid4().hex[:8] + "_"
    names = showcase.pipeline(spark, d, showcase.CONTACT).create_views(prefix)
    wanted = [n for n in names if n.removeprefix(prefix) in ("contact", "crm_forward", "contact_identified", "erp_inserts", "erp_updates")]
    return spark.sql(" UNION ALL ".join(f"SELECT '{n.removeprefix(prefix)}' AS stage, count(*) AS n FROM {n}" for n in wanted))


@query(showcase.ORACLE["contact_updates"])
def written_tables(spark: SparkSession, d: str) -> DataFrame:
    """Golden records and deltas as tables with unique keys."""
    folder = _folder(spark, "tables")
    showcase.pipeline(spark, d, showcase.CONTACT).write(folder)
    return showcase._id(spark.read.parquet(f"{folder}/erp_updates"))


@query("SELECT * FROM (VALUES ('distinct', FALSE), ('null twice', TRUE), ('twice', TRUE)) AS t(rows, refused)")
def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    """A key that occurs twice is refused; NULLs count as equal."""
    out = []
    for name, rows in (("distinct", [("a", None), ("a", "b")]), ("null twice", [("a", None), ("a", None)]), ("twice", [("a", "b"), ("a", "b")])):
        try:
            assert_unique(spark.createDataFrame(rows, "k string, l string"), ["k", "l"], name)
            out.append((name, False))
        except NotUnique:
            out.append((name, True))
    return spark.createDataFrame(out, "rows string, refused boolean")


@query(
    """SELECT * FROM (VALUES ('upper(name) || ''; drop''', TRUE), ('name; drop table x', FALSE), ('(select 1)', FALSE), ('a) or (b', FALSE), ('''open', FALSE), ('_written_crm = 1', FALSE), ('CASE WHEN a > 1 THEN b ELSE c END', TRUE), ('"order" = 1', TRUE)) AS t(text, allowed)"""
)
def safe_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Which texts may stand where a document takes an expression."""
    out = []
    for text in ("upper(name) || '; drop'", "name; drop table x", "(select 1)", "a) or (b", "'open", "_written_crm = 1", "CASE WHEN a > 1 THEN b ELSE c END", '"order" = 1'):
        try:
            X.check_expression(text)
            out.append((text, True))
        except X.ExpressionError:
            out.append((text, False))
    return spark.createDataFrame(out, "text string, allowed boolean")


@query(
    """SELECT * FROM (VALUES ('shape', '/version'), ('shape', '/targets/contact/colour'), ('shape', '/targets/contact'), ('shape', '/mappings/0/name'), ('meaning', '/mappings/crm/source'), ('meaning', '/targets/contact/identity'), ('meaning', '/mappings/erp'), ('meaning', '/mappings/crm'),
    ('names', '/output/colour'), ('names', '/output'), ('hierarchy', '/targets/contact/fields/name/hierarchy')) AS t(kind, path)"""
)
def document_findings(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is wrong with a document, with its place."""
    text = showcase.CONTACT
    broken = {
        "shape": text.replace('"2.0"', '"3.0"').replace("identity: [email]", "colour: red").replace("name: crm,", "name: CRM,"),
        "meaning": text.replace("source: crm, target: contact", "source: gone, target: contact").replace("identity: [email]", "identity: [mail]"),
        "names": showcase.CLOSURE.replace("sources:", "output: { colour: red, _action: what, _mapping: what }\nsources:", 1),
        "hierarchy": showcase.CLOSURE.replace("name: { strategy: coalesce }", "name: { strategy: coalesce, hierarchy: { a: b, b: a } }"),
    }
    out = []
    for kind, t in broken.items():
        try:
            parse(t)
        except DocumentError as e:
            out += [(kind, path) for path in dict.fromkeys(p for p, _ in e.errors)]
    return spark.createDataFrame(out, "kind string, path string")


@query("SELECT * FROM (VALUES ('an array', FALSE, 2), ('no value', FALSE, 0), ('an object', TRUE, 0), ('no JSON', TRUE, 0), ('two identity groups', TRUE, NULL)) AS t(kind, refused, lenient)")
def strict_reading(spark: SparkSession, d: str) -> DataFrame:
    """What a strict pipeline refuses, and the elements that a lenient one reads there."""
    doc = parse("""
version: "1.0"
sources: { a: { primary_key: id } }
targets: { t: { fields: { k: { strategy: identity } } }, e: { fields: { n: { strategy: identity }, t: { strategy: coalesce } } } }
mappings:
  - { name: a, source: a, target: t, fields: [{ source: id, target: k }] }
  - { name: a_e, parent: a, array: es, parent_fields: { up: id }, target: e, fields: [{ source: n, target: n }, { source: up, target: t }] }
""")
    out = []
    for kind, text in (("an array", '[{"n": 1}, {"n": 2}]'), ("no value", None), ("an object", '{"n": 1}'), ("no JSON", "[{")):
        rows = {"a": spark.createDataFrame([("1", text)], "id string, es string")}
        try:
            Pipeline(doc, rows, strict=True).forward("a_e").collect()
            refused = False
        except Exception as e:  # noqa: BLE001  the job's error, whatever wraps it
            refused = "not a JSON array" in str(e)
        lenient = Pipeline(doc, rows).forward("a_e").where("v_n is not null").count() if kind != "an object" else 0
        out.append((kind, refused, lenient))
    two = parse(showcase.CONTACT.replace("identity: [email]", "identity: [email, name]"))
    try:
        Pipeline(two, {"crm": showcase.system(spark, d, showcase.SYSTEMS["crm"])}, strict=True)
        out.append(("two identity groups", False, None))
    except DocumentError:
        out.append(("two identity groups", True, None))
    return spark.createDataFrame(out, "kind string, refused boolean, lenient int")


@query(showcase._BOTH + ", u AS (SELECT count(*) AS n FROM g WHERE eid IS NULL) SELECT l AS most, n > l AS refused FROM u, (VALUES (0), (1000000)) AS t(l)")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Deltas beyond a limit are refused before anything is written."""
    deltas, out = showcase.pipeline(spark, d, showcase.CONTACT).deltas("erp"), []
    for most in (0, 1_000_000):
        try:
            guarded(deltas, inserts=most)
            out.append((most, False))
        except TooManyChanges:
            out.append((most, True))
    return spark.createDataFrame(out, "most int, refused boolean")


@query(
    """SELECT p_brand AS brand, '{' || string_agg('"' || p_type || '":"' || k || '"', ',' ORDER BY p_type) || '}' AS first_keys, CAST(count(*) AS STRING) AS n, max(upper(substring(p_type, 1, 3))) AS word, '[' || max(p_size) || ',' || min(p_size) || ']' AS pair
    FROM (SELECT *, CAST(min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS STRING) AS k, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS r FROM part) WHERE r = 1 GROUP BY p_brand"""
)
def json_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """JSON functions in the documents' dialect, as fields that are expressions over an entity's rows."""
    text = """
version: "1.0"
sources: { parts: { primary_key: pk } }
targets:
  brand:
    fields:
      brand: { strategy: identity }
      type: { strategy: coalesce }
      key: { strategy: coalesce }
      size: { strategy: coalesce }
      first_keys: { strategy: expression, type: jsonb, expression: "jsonb_object_agg(type, key)" }
      n: { strategy: expression, expression: "count(type)" }
      word: { strategy: expression, expression: "max(upper(substring(type, 1, 3)))" }
      pair: { strategy: expression, type: jsonb, expression: "jsonb_build_array(max(size::integer), min(size::integer))" }
mappings: [{ name: parts, source: parts, target: brand, fields: [{ source: brand, target: brand }, { source: type, target: type }, { source: pk, target: key }, { source: size, target: size }] }]
"""
    parts = showcase.system(spark, d, "SELECT * FROM (SELECT p_brand AS brand, p_type AS type, CAST(min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS STRING) AS pk, p_size AS size, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS r FROM {part}) WHERE r = 1")
    return Pipeline(parse(text), {"parts": parts}).record("brand").select("brand", "first_keys", "n", "word", "pair")


_STREAMED = showcase._BOTH.replace("c.name AS cname", "CASE WHEN CAST(c.id AS BIGINT) % 5 = 0 THEN 'renamed ' || c.id ELSE c.name END AS cname")


@query(_STREAMED + " SELECT 1 AS batch, canonical_id, eid AS id, name AS contact_name, TRUE AS state FROM g WHERE eid IS NOT NULL AND (name IS DISTINCT FROM ename OR segment IS DISTINCT FROM eseg)")
def streamed_updates(spark: SparkSession, d: str) -> DataFrame:
    """Two micro-batches, each with a stream of its own as after a restart: the second's deltas know the first's rows and state."""
    folder = _folder(spark, "stream")
    doc = parse(showcase.CONTACT)
    systems = {n: showcase.system(spark, d, showcase.SYSTEMS[n]).withColumns({SOURCE: F.lit(n), ORDER: F.lit(0).cast("long")}) for n in doc.sources}
    first = systems["crm"].unionByName(systems["erp"], allowMissingColumns=True)
    changed = systems["crm"].where("cast(id as bigint) % 5 = 0").withColumns({"name": F.concat(F.lit("renamed "), "id"), ORDER: F.lit(1).cast("long")})
    changed = changed.unionByName(first.limit(0), allowMissingColumns=True).select(*first.columns)

    def sink(pipe: Pipeline, number: int) -> dict[str, DataFrame]:
        known = F.lit(bool(pipe.state))
        pipe.deltas("erp").updates.select(F.lit(number).alias("batch"), F.col("_canonical_id").alias("canonical_id"), "id", "contact_name", known.alias("state")).write.mode("overwrite").parquet(f"{folder}/out/{number}")
        return {"_cluster_members_erp": feed_back(pipe, "erp", [], "2024-01-01")[0]}

    for rows in (first, changed):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(first.schema).parquet(f"{folder}/in")
        run = refresh(stream, doc, Snapshots(spark, doc, f"{folder}/snapshots", buckets=4), sink, f"{folder}/checkpoint", trigger={"availableNow": True})
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out/1")
