"""The pipeline against the same stages done plainly, and each stage on odd rows."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from goldweave.llm import langid, packing
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def masked(text):
    out, at = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in brute.base_spans(text)):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def test_run_equals_the_plain_stages(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = langid.fit_filters(spark.read.parquet(f"{SF}/documents.parquet"))
    langs, _, shares = langid.predict(model, list(docs.values()))
    docs = {i: t for (i, t), lang, s in zip(docs.items(), langs, shares, strict=True) if lang != "und" and s >= corpus_pipeline.LEAST_RECOGNISED}
    assert len(docs) > 190  # clean documents stay
    root = brute.classes(list(docs.items()))
    docs = {i: t for i, t in docs.items() if root[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: t for (i, t), hit in zip(docs.items(), brute.decontaminated(docs.values(), items), strict=True) if not hit[1]}
    docs = {i: masked(t) for i, t in docs.items()}
    slow = packing._tokenizer(packing.default_tokenizer())
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(got) == set(docs)
    for i, t in docs.items():
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for start, length, crc in sorted(got[i]):
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)


def test_junk_goes_and_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(7)
    word = lambda letters, n: "".join(rng.choice(list(letters), n))
    junk = [" ".join(word("0123456789abcdef", 16) for _ in range(40)) for _ in range(10)]
    junk += [" ".join(f"{rng.integers(0, 9999)}{rng.choice(['kg', 'cm', 'px', ''])}" for _ in range(60)) for _ in range(10)]
    junk += [word("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 600) for _ in range(10)]
    junk += ["", "   ", "12 345", "\u00b2\u00bd"]
    more = spark.createDataFrame([(-i - 1, t, None, "junk", len(t)) for i, t in enumerate(junk)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(more), SF).select("doc_id").collect()}
    assert not any(i < 0 for i in kept)
    clean = {r["doc_id"] for r in docs.collect() if sum(c.isalpha() for c in r["text"] or "") > 20}
    assert len(clean - kept) <= len(clean) // 1000


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_the_columns(spark, number):
    rows = [(1, "some words of a text", "en", "s", 20), (1, "some words of a text", "en", "s", 20), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "without an id", "en", None, 3), (4, "!!!", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = corpus_pipeline.STAGES[number][1]
    for part in (docs, docs.limit(0)):
        out = stage(spark, part, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert out.count() <= part.count()


def test_packing_takes_odd_rows(spark):
    rows = [(1, "some words of a text"), (1, "some words of a text"), (2, None), (3, ""), (None, "without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("tokens", "pieces", "place", "curve", "id", "start", "sequence_id")})
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in out.where("start = 0").collect()) == ["1", "1", "2", "3", "None"]
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), SF).count() == 0
