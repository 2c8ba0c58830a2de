"""Each query on a small table against a plain version of it."""

import hashlib
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from goldweave.llm import neardup, packing, shards, token_counts, toxicity
from goldweave.llm.queries import ORACLE, QUERIES
from tests.llm import brute

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))


def test_shards(spark, documents):
    rows = result(spark, "op1_hilbert_shards")
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    by = defaultdict(list)
    for r in rows:
        raw = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by[r["shard"]].append(r)
    assert set(by) <= set(range(40))
    counts = [len(by[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    order = [r["hilbert"] for s in range(40) for r in sorted(by[s], key=lambda r: r["slot"])]
    assert order == sorted(order)


def test_hilbert_index_walks_the_whole_cube():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        index = shards.hilbert_index(cells, bits)
        assert sorted(index.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(index)].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_near_duplicates(spark, documents):
    want = brute.classes([(i, r["text"]) for i, r in documents.items()])
    got = {r["doc_id"]: r["class_id"] for r in result(spark, "op2_bagminhash")}
    assert got == want


def test_signatures_are_unbiased_for_weighted_bags():
    keys = np.arange(1, 60, dtype=np.uint64)
    rng = np.random.default_rng(1)
    for _ in range(4):
        a, b = rng.integers(1, 40, 59), rng.integers(1, 40, 59)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        s = neardup.signatures([(keys, a), (keys, b)], 4000)
        assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_personal_data(spark, documents):
    for r in result(spark, "op3_bootstrapped_pii"):
        spans = brute.base_spans(documents[r["doc_id"]]["text"])
        assert [r[f"n_{k}"] for k in brute.BASE] == [sum(s[0] == k for s in spans) for k in brute.BASE]
        assert r["base_sha256"] == hashlib.sha256(brute.spans_text(spans).encode()).hexdigest()
        assert set(brute.spans_text(spans).split(",")) <= set(r["spans"].split(",")) | {""}


def test_toxicity_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"  # the smaller tables hold a dozen toxic held-out rows, too few to tell
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = QUERIES["op4_toxicity_trees"](spark, big).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    test = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pos, neg = np.array([s for s, y in test if y]), np.array([s for s, y in test if not y])
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert auc > 0.98 and (pos >= 0.3).mean() > 0.9 and (neg >= 0.3).mean() < 0.02


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    m = toxicity.fit_trees(x, y).margin(x)
    assert ((m > 0) == y).mean() > 0.97
    at, p = toxicity.isotonic(m, y)
    assert (np.diff(at) >= 0).all() and (np.diff(p) > 0).all()


def test_packing(spark, documents):
    rows = result(spark, "op5_hilbert_packing")
    slow = packing._tokenizer(packing.default_tokenizer())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(documents)
    for i, pieces in by_doc.items():
        ids = np.array([*slow.encode(documents[i]["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert sum(r["length"] for r in rows) / (1024 * len(by_seq)) > 0.95


def test_neighbours_on_the_curve_share_sequences(spark):
    """The documents of a sequence are nearer to each other than documents at random."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    place = {r["id"]: np.array(r["place"]) for r in packing.document_pieces(docs, packing.default_tokenizer(), "doc_id", "text").collect()}
    by_seq = defaultdict(set)
    for r in packing.pack(docs).collect():
        by_seq[r["sequence_id"]].add(r["doc_id"])
    pairs = [(a, b) for s in by_seq.values() for a in s for b in s if a < b]
    rng = np.random.default_rng(0)
    every = list(place)
    chance = [tuple(rng.choice(every, 2)) for _ in range(5000)]
    apart = lambda xs: np.mean([np.linalg.norm(place[a] - place[b]) for a, b in xs])
    assert apart(pairs) < 0.6 * apart(chance)


def test_ranks_agree_with_the_library():
    path = packing.default_tokenizer()
    slow = packing._tokenizer(path)
    texts = ["", " ", "a  b", "it's  \n\n x", "<|endoftext|> a<|endoftext|>", "é" * 50 + " 12 345", "\t\r\n a", "日本語 text", "a\u2028b\x85c\x1cd", "𝔘 n", "x" * 70000, "word " * 30000, "…“q”–—'ll we're"]
    want = [slow.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_counts.by_ranks(path)
    for ranked in (True, False):
        assert [e.tolist() for e in packing.encode(texts, path, ranked)] == want
        assert token_counts._lengths(path, texts, 1 << 16, 1 << 19, ranked) == [len(w) for w in want]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_decontamination(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = result(spark, "op7_decontaminate")
    want = dict(zip(documents, brute.decontaminated([r["text"] for r in documents.values()], items), strict=True))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows} == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in rows) and any(r["contaminated"] for r in rows)


def test_token_counts(spark, documents):
    slow = packing._tokenizer(packing.default_tokenizer())
    for r in result(spark, "op8_token_counts"):
        text = documents[r["doc_id"]]["text"] or ""
        n = len(slow.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_safe_pieces_change_no_count():
    slow = packing._tokenizer(packing.default_tokenizer())
    text = "It's a  test, of 12 345 words\n and <|endoftext|> more ünï ones. " * 40
    pieces = token_counts.safe_pieces(text, 50)
    assert "".join(pieces) == text and len(pieces) > 20
    assert sum(len(slow.encode(p, add_special_tokens=False).ids) for p in pieces) == len(slow.encode(text, add_special_tokens=False).ids)


def test_language_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op10_language_bitmask"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    test = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(test) / len(test) > 0.98
