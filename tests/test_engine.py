"""Documents, expressions, paths, keys, clustering and streaming on their own."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from goldweave import cli
from goldweave.functions import expressions as X
from goldweave.functions.jsonpath import parse_path, read_path, write_paths
from goldweave.operators.components import components
from goldweave.plans.golden import pipeline_of
from goldweave.plans.model import DocumentError, merge, parse
from goldweave.sources import registry

BASIC = """
version: "2.0"
sources: { a: { primary_key: id }, b: { primary_key: id } }
targets: { t: { identity: [k], fields: { k: { strategy: coalesce }, v: { strategy: coalesce } } } }
mappings:
  - { name: a, source: a, target: t, fields: [{ source: k, target: k }, { source: v, target: v, priority: 1 }] }
  - { name: b, source: b, target: t, fields: [{ source: key, target: k }, { source: val, target: v, priority: 2 }] }
"""


def errors(text):
    with pytest.raises(DocumentError) as e:
        parse(text)
    return dict(e.value.errors)


def test_document_model():
    doc = parse(BASIC)
    assert list(doc.sources) == ["a", "b"] and doc.targets["t"].identity == (("k",),) and doc.mappings["b"].order == 1
    assert doc.mappings["a"].field_of("v").priority == 1


def test_all_shape_errors_at_once():
    found = errors(BASIC.replace('"2.0"', '"3.0"').replace("identity: [k],", "colour: red,").replace("{ name: a, source: a", "{ name: A, source: a"))
    assert {"/version", "/targets/t/colour", "/targets/t", "/mappings/0/name"} <= set(found)


@pytest.mark.parametrize(
    "change,path",
    [
        (("source: a, target: t", "source: zz, target: t"), "/mappings/a/source"),
        (("identity: [k]", "identity: [nope]"), "/targets/t/identity"),
        (("{ source: k, target: k }, ", ""), "/mappings/a"),
        (("name: b, source: b,", "name: b, source: b, array: xs,"), "/mappings/b"),
        (("target: v, priority: 2", "target: v, references: gone"), "/mappings/b/fields/1/references"),
        (("v: { strategy: coalesce }", "v: { strategy: best }"), "/targets/t/fields/v/strategy"),
    ],
)
def test_meaning_errors(change, path):
    assert path in errors(BASIC.replace(*change))


def test_unsafe_expressions_are_refused():
    for text in ("1; drop table x", "(select 1)", "delete from t", "a)", "'a", "_written_x = 1"):
        with pytest.raises(X.ExpressionError):
            X.check_expression(text)
    X.check_expression("name = 'drop; select'")
    X.check_expression("COALESCE((SELECT count(*) FROM o), 0)", query=True)


@pytest.mark.parametrize(
    "text,want",
    [
        ("x::numeric + 1", "13.5"), ("trunc(x::numeric, 0)::integer::text", "12"), ("trunc(x::numeric, 1)::text", "12.5"), ("x::numeric::text", "12.5"), ("j->'a'->>0", "p"), ("j->'b.c'->>'d'", "q"),
        ("left(s, 2) || '-' || upper(s)", "ab-ABC"), ("s IS NOT TRUE OR s = 'abc'", None), ("split_part('a,b', ',', 2)", "b"), ("CASE WHEN x::numeric > 12 THEN 'big' ELSE 'small' END", "big"), ("'it''s'", "it's"),
    ],
)
def test_postgres_spelling(spark, text, want):
    df = spark.createDataFrame([("12.50", '{"a":["p"],"b.c":{"d":"q"}}', "abc")], "x string, j string, s string")
    if want is None:
        text = text.replace("s IS NOT TRUE", "(s = 'abc') IS NOT TRUE")
        want = "true"
    got = df.select(F.expr(X.to_spark(text)).cast("string")).first()[0]
    assert got == want or float(got) == float(want)


def test_curated_predicates(spark):
    df = spark.createDataFrame([("a", "5"), ("b", "50"), (None, None)], "n string, v string")
    keep = lambda spec: [r["n"] for r in df.where(X.predicate(spec, F.col)).collect()]
    a, big = {"equals": {"field": "n", "value": "a"}}, {"gt": {"field": "v", "value": 10}}
    assert keep(a) == ["a"] and keep(big) == ["b"] and keep({"in": {"field": "n", "values": ["a", "b"]}}) == ["a", "b"]
    assert keep({"not": a}) == ["b"] and keep({"or": [a, big]}) == ["a", "b"] and keep({"and": [a, big]}) == [] and keep({"is_null": {"field": "n"}}) == [None]
    assert keep({"sql": "v::numeric < 10", "sparql": "..."}) == ["a"] and keep({"and": [{"not_null": {"field": "n"}}, {"sql": "v::numeric < 10"}]}) == ["a"]
    assert X.predicate_names({"and": [a, {"not": big}, {"sql": "x > 1"}]}) == ["n", "v", "x"]


def test_curated_normalisers(spark):
    df = spark.createDataFrame([(" Ünï 1.256 ",)], "s string").select("s", F.lit("-1.256").alias("n"), F.lit("2024-03-05 10:11:12").alias("t"), F.lit(None).cast("string").alias("e"))
    one = lambda c, spec: df.select(X.normalized(c, spec).cast("string")).first()[0]
    assert one("s", ["trim", "lowercase", "ascii_fold"]) == "uni 1.256" and one("n", {"truncate": {"decimals": 2}}) == "-1.25" and one("n", {"round": {"decimals": 2}}) == "-1.26"
    assert one("n", {"clamp": {"min": 0, "max": 9}}) == "0" and one("s", ["trim", {"truncate": {"length": 3}}]) == "Ünï" and one("t", {"truncate_time": {"precision": "month"}}).startswith("2024-03-01")
    assert one("n", {"pad": {"width": 8, "char": "0"}}) == "00-1.256" and one("n", {"pad": {"width": 3}}) == "-1.256" and one("s", "strip_non_digits") == "1256" and one("e", {"null_as": {"value": False}}) == "false"


def test_field_transforms(spark):
    doc = parse("""
version: "1.0"
sources: { a: { primary_key: id }, b: { primary_key: id } }
targets: { t: { fields: { k: { strategy: identity }, full: { strategy: coalesce }, n: { strategy: coalesce, default: { value: 7 } }, land: { strategy: coalesce }, note: { strategy: coalesce, default: { sql: "upper(land)" } } } } }
mappings:
  - { name: a, source: a, target: t, priority: 2, fields: [{ source: id, target: k }, { target: full, sources: [f, l], join: { sep: " " }, split: { sep: " ", limit: 2 } }, { source: num, target: n, transform: { cast: integer } }, { source: c, target: land, value_map: { NO: Norway, SE: Sweden }, value_map_fallback: "null" }] }
  - { name: b, source: b, target: t, priority: 1, fields: [{ source: id, target: k }, { source: name, target: full }, { source: land, target: land }, { source: note, target: note }] }
""")
    rows = {"a": [{"id": "1", "f": "Al", "l": "B", "num": "x1", "c": "NO"}, {"id": "2", "f": "Al", "l": None, "num": "0012", "c": "XX"}], "b": [{"id": "1", "name": "Mary Beth Smith", "land": "Sweden", "note": None}, {"id": "3", "name": "Mary", "land": "Norway", "note": "n"}]}
    pipe = pipeline_of(spark, doc, rows)
    got = [tuple(r)[1:] for r in pipe.record("t").orderBy("k").collect()]
    assert got == [("1", "Mary Beth Smith", "7", "Sweden", "SWEDEN"), ("2", "Al ", "12", None, None), ("3", "Mary", "7", "Norway", "n")]
    d = pipe.deltas("a")
    assert [(r["id"], r["f"], r["l"], r["c"]) for r in d.updates.orderBy("id").collect()] == [("1", "Mary", "Beth Smith", "SE"), ("2", "Al", "", None)]
    assert [(r["f"], r["l"], r["c"]) for r in d.inserts.collect()] == [("Mary", None, "NO")]


def test_json_paths(spark):
    assert parse_path("m.['a.b'].c[0].d") == ["m", "a.b", "c", 0, "d"]
    doc = json.dumps({"a.b": {"c": [{"d": "1", "e": 2}]}, "k": True})
    df = spark.createDataFrame([(doc, "9"), (None, "9"), (doc, None), (None, None)], "j string, v string")
    got = [r for r in write_paths(df, F.col("j"), [(["a.b", "c", 0, "d"], F.col("v"), None)], "w").select(read_path(F.col("j"), ["a.b", "c", 0, "d"]).alias("r"), "w").collect()]
    assert [r["r"] for r in got] == ["1", None, "1", None]
    assert json.loads(got[0]["w"]) == {"a.b": {"c": [{"d": "9", "e": 2}]}, "k": True} and json.loads(got[1]["w"]) == {"a.b": {"c": [{"d": "9"}]}} and json.loads(got[2]["w"])["a.b"]["c"][0]["d"] is None and got[3]["w"] is None


def test_written_values_keep_their_json_types(spark):
    doc = json.dumps({"n": 5, "f": True, "s": "5", "x": 1.50, "o": {"deep": [1, {"k": False}]}})
    rows = [(doc, "5", "true"), (doc, "6", "no"), (doc, None, None), ("[1]", "7", "false"), (None, "7", None)]
    df = spark.createDataFrame(rows, "j string, v string, b string")
    v, b = F.col("v"), F.col("b")
    leaves = [(["n"], v, None), (["s"], v, None), (["new"], v, "numeric"), (["f"], b, None), (["o", "deep", 1, "k"], b, None), (["o", "deep", 2], v, None)]
    got = [None if r["w"] is None else json.loads(r["w"]) for r in write_paths(df, F.col("j"), leaves, "w").collect()]
    assert got[0] == {"n": 5, "f": True, "s": "5", "x": 1.5, "new": 5, "o": {"deep": [1, {"k": True}, "5"]}}
    assert got[1] == {"n": 6, "f": "no", "s": "6", "x": 1.5, "new": 6, "o": {"deep": [1, {"k": "no"}, "6"]}}
    assert got[2] == {"n": None, "f": None, "s": None, "x": 1.5, "o": {"deep": [1, {"k": None}]}}
    assert got[3] == {"n": "7", "s": "7", "new": 7, "f": "false", "o": {"deep": [None, {"k": "false"}, "7"]}}
    assert got[4] == {"n": "7", "s": "7", "new": 7, "o": {"deep": [None, None, "7"]}}


def test_linked_order():
    from goldweave.operators.ordered import walk

    names = lambda xs: [xs[i][0] for i in walk(xs)]
    assert names([("c", "b", None), ("a", None, "b"), ("b", "a", "c")]) == ["a", "b", "c"]
    # d and c both follow b: d names c as its follower, so it goes first
    assert names([("a", None, "b"), ("b", "a", "c"), ("c", "b", None), ("d", "b", "c")]) == ["a", "b", "d", "c"]
    # two claim the head; b names y, so y goes before x; what follows each stays with it
    assert names([("b", None, "y"), ("x", "b", None), ("x2", "x", None), ("y", "b", None), ("a", "gone", None)]) == ["a", "b", "y", "x", "x2"]
    assert names([("p", "q", "q"), ("q", "p", "p"), ("a", None, None)]) == ["a", "p", "q"]
    assert names([("s", "s", "s")]) == ["s"] and names([]) == []
    rng = random.Random(4)
    for _ in range(200):
        xs = [(rng.choice("abcdef"), rng.choice([None, *"abcdef"]), rng.choice([None, *"abcdef"])) for _ in range(rng.randint(0, 9))]
        assert sorted(walk(xs)) == list(range(len(xs)))


def test_key_codec_is_exact(spark):
    keys = ["a b", "x/y?z", "50%", "~-._", "ünï", "a+b*c", "", "'\"<>"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for r in df.select("k", registry.encode_key(F.col("k")).alias("e"), registry.decode_key(registry.encode_key(F.col("k"))).alias("d")).collect():
        assert r["e"] == registry.row_key(r["k"]) and r["d"] == r["k"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_long_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {r["root"] for r in components(df).collect()} == {0}


def test_random_documents_are_consistent(spark):
    """Applying the deltas makes every source agree, and then nothing is left to do."""
    doc = parse(BASIC)
    rng = random.Random(3)
    a = [{"id": str(i), "k": rng.choice("pqrst") + rng.choice("12"), "v": rng.choice(["x", "y", None])} for i in range(14)]
    a = list({r["k"]: r for r in a}.values())
    b = [{"id": str(i), "key": rng.choice("pqrst") + rng.choice("12"), "val": rng.choice(["x", "z"])} for i in range(14)]
    b = list({r["key"]: r for r in b}.values())
    state = {"a": a, "b": b}
    for step in range(2):
        pipe = pipeline_of(spark, doc, state)
        after = {}
        for m in ("a", "b"):
            d = pipe.deltas(m)
            rows = {r["id"]: r for r in state[m]}
            for r in d.updates.collect():
                rows[r["id"]] = {k: v for k, v in r.asDict().items() if k != "_canonical_id"}
            for i, r in enumerate(d.inserts.collect()):
                rows[f"new{step}{i}"] = {k: v for k, v in r.asDict().items() if k != "_canonical_id"} | {"id": f"new{step}{i}"}
            assert d.deletes.count() == 0
            changes = d.updates.count() + d.inserts.count()
            assert step == 0 or changes == 0
            after[m] = list(rows.values())
        state = after


def test_several_files_are_one_document():
    out = merge([{"version": "2.0", "sources": {"a": {}}}, {"version": "2.0", "sources": {"b": {}}, "mappings": [{"name": "m"}]}])
    assert list(out["sources"]) == ["a", "b"]
    with pytest.raises(DocumentError):
        merge([{"sources": {"a": {}}}, {"sources": {"a": {}}}])


def test_command_line(tmp_path, capsys):
    good, bad = tmp_path / "good.yaml", tmp_path / "bad.yaml"
    good.write_text(BASIC)
    bad.write_text(BASIC.replace("identity: [k]", "identity: [nope]"))
    assert cli.main(["validate", str(good)]) == 0 and cli.main(["validate", str(bad)]) == 1
    assert "unknown field" in capsys.readouterr().err
    assert cli.main(["explain", str(good)]) == 0 and "target t" in capsys.readouterr().out
    assert cli.main(["dot", str(good)]) == 0 and "digraph" in capsys.readouterr().out
    assert cli.main(["parse", str(good)]) == 0 and json.loads(capsys.readouterr().out)["version"] == "2.0"


def test_streamed_refresh(spark, tmp_path):
    from goldweave.streaming.refresh import Snapshots, feed_back, refresh

    doc = parse(BASIC)
    schema = "_source string, _order long, _deleted boolean, id string, k string, v string, key string, val string"
    inbox = str(tmp_path / "in")
    seen = {}

    def sink(pipe, number):
        seen[number] = {m: sorted((r["_action"], r["id"]) for r in pipe.deltas(m).changes().collect()) for m in ("a", "b")} | {"fed": feed_back(pipe, "b", [], "2024-01-01")[0].count()}

    def put_rows(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)

    put_rows([("a", 1, None, "1", "p", "x", None, None), ("b", 1, None, "9", None, None, "p", "y")])
    stream = spark.readStream.schema(schema).parquet(inbox)
    def run():  # each time as a new process would: nothing but the folders is carried over
        query = refresh(stream, doc, Snapshots(spark, doc, str(tmp_path / "snap"), buckets=4), sink, str(tmp_path / "cp"))
        query.processAllAvailable()
        return query

    query = run()
    put_rows([("a", 2, None, "2", "q", "z", None, None), ("b", 2, None, "9", None, None, "p", "x")])
    query.processAllAvailable()
    query.stop()
    put_rows([("a", 3, True, "2", None, None, None, None)])
    run().stop()
    assert seen[0]["b"] == [("update", "9")] and seen[1]["b"] == [("insert", None)] and seen[2]["b"] == [] and seen[0]["fed"] == 1
    # what the first process read is still there, and the last batch's manifest alone says so
    held = Snapshots(spark, doc, str(tmp_path / "snap"))
    assert [(r["id"], r["v"]) for r in held.read(held.before()["a"]).collect()] == [("1", "x")]
    # a batch that is run again starts from the one before it
    assert sorted(r["id"] for r in held.read(held.before(2)["a"]).collect()) == ["1", "2"]


def test_state_of_one_batch_reaches_the_next(spark, tmp_path):
    from goldweave.streaming.refresh import Snapshots, feed_back, refresh

    doc = parse(BASIC.replace('"2.0"', '"1.0"').replace("{ t: { identity: [k], fields: { k: { strategy: coalesce }", "{ t: { fields: { k: { strategy: identity }").replace("name: b, source: b, target: t,", "name: b, source: b, target: t, written_state: true, derive_noop: true,"))
    schema = "_source string, _order long, id string, k string, v string, key string, val string"
    inbox, seen = str(tmp_path / "in"), []

    def sink(pipe, number):
        seen.append((sorted(pipe.state), sorted((r["_action"], r["id"]) for r in pipe.deltas("b").changes().collect())))
        return {"_written_b": feed_back(pipe, "b", [], "2024-01-01")[1]}

    for k, rows in enumerate([[("a", 1, "1", "p", "x", None, None), ("b", 1, "9", None, None, "p", "y")], [("a", 2, "2", "q", "z", None, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        query = refresh(spark.readStream.schema(schema).parquet(inbox), doc, Snapshots(spark, doc, str(tmp_path / "snap")), sink, str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()
    # the first batch wrote x for p; the source still shows y, which the second batch therefore knows to be on its way
    assert seen == [([], [("update", "9")]), (["_written_b"], [("insert", None)])]


def test_element_deltas_and_views(spark):
    doc = parse("""
version: "1.0"
sources: { a: { primary_key: id }, b: { primary_key: id } }
targets: { p: { fields: { k: { strategy: identity } } }, e: { fields: { p: { strategy: identity, references: p, link_group: g }, n: { strategy: identity, link_group: g }, v: { strategy: coalesce } } } }
mappings:
  - { name: a, source: a, target: p, written_state: true, fields: [{ source: id, target: k }] }
  - { name: a_e, parent: a, array: es, parent_fields: { up: id }, target: e, fields: [{ source: up, target: p, references: a }, { source: n, target: n }, { source: v, target: v }] }
  - { name: b, source: b, target: e, fields: [{ source: p, target: p, references: a }, { source: n, target: n }, { source: v, target: v }] }
""")
    pipe = pipeline_of(spark, doc, {"a": [{"id": "1", "es": [{"n": "x", "v": "1"}, {"n": "y", "v": "2"}]}], "b": [{"id": "q", "p": "1", "n": "w", "v": "9"}], "_written_a": [{"_cluster_id": "a:1", "_written": '{"es": [{"n": "x", "v": "0"}, {"n": "z", "v": "3"}]}'}]})
    assert sorted((r["n"], r["_element_action"]) for r in pipe.element_deltas("a_e").collect()) == [("w", "insert"), ("x", "present"), ("y", "insert"), ("z", "delete")]
    names = pipe.create_views("t_")
    assert {"t_a_forward", "t_e_identified", "t_p", "t_b_updates", "t_a_changes"} <= set(names)
    assert spark.sql("select count(*) from t_e").first()[0] == 3


def test_hot_and_missing_keys(spark):
    """A key shared by most rows, and rows without a key, neither meet in a window nor merge."""
    doc = parse(BASIC)
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), F.lit("v").alias("v"))
    from goldweave.plans.pipeline import Pipeline

    pipe = Pipeline(doc, {"a": rows, "b": spark.createDataFrame([], "id string, key string, val string")})
    assert pipe.record("t").count() == 2001
    plan = pipe.identified("t")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_explicit_nulls_hashes_and_limits(spark):
    import hashlib

    from goldweave.operators.delta import TooManyChanges, guarded

    doc = parse(BASIC.replace('"2.0"', '"1.0"').replace("{ t: { identity: [k], fields: { k: { strategy: coalesce }", "{ t: { fields: { k: { strategy: identity }").replace("target: v, priority: 1", "target: v, priority: 1, null_wins: true"))
    pipe = pipeline_of(spark, doc, {"a": [{"id": "1", "k": "p", "v": None}], "b": [{"id": "9", "key": "p", "val": "y"}]})
    r = pipe.record("t", hashed=True).first()
    assert r["v"] is None and r["_identity_hash"] == hashlib.sha256(b"p").hexdigest()
    d = pipe.deltas("b")
    assert [tuple(x)[1:] for x in d.updates.collect()] == [("9", "p", None)]
    assert guarded(d, updates=1, deletes=0) is d
    with pytest.raises(TooManyChanges):
        guarded(d, updates=0)


def test_odd_sources(spark):
    """Typed and nested columns, extra columns, rows without a key, and sources without rows."""
    from goldweave.plans.pipeline import Pipeline

    doc = parse(BASIC)
    a = spark.createDataFrame([(1, "p", 1.5, {"x": 1}), (None, "q", 2.0, None), (2, None, None, {})], "id int, k string, v double, __raw map<string,int>")
    pipe = Pipeline(doc, {"a": a})
    assert sorted(map(str, (tuple(r)[1:] for r in pipe.record("t").collect()))) == sorted(map(str, [("p", "1.5"), ("q", "2.0"), (None, None)]))
    assert sorted(str((r["key"], r["val"])) for r in pipe.deltas("b").inserts.collect()) == sorted(map(str, [("p", "1.5"), ("q", "2.0"), (None, None)]))
    assert [r["k"] for r in pipe.deltas("a").inserts.collect()] == ["q"] and pipe.deltas("a").updates.count() == 0
    with pytest.raises(DocumentError):
        Pipeline(doc, {"a": a.drop("id")})
    with pytest.raises(DocumentError, match="no column 'k'"):
        Pipeline(doc, {"a": a.withColumnRenamed("k", "other")})
