"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldweave.llm import chat, decontaminate, langid, neardup, packing, pii, shards, token_counts, topk, toxicity
from tests.llm import brute

LONG = "alpha beta gamma delta " * 20000
TEXTS = [None, "", "   ", "!!! ...", "one", "a@b.co +1 (743) 555-3824 x", LONG, LONG, "same text of a few words here", "same text of a few words here", "日本語のテキスト", "x" * 100_000]
EXTRA = "doc_id bigint, text string, id bigint, n_tokens string, score string, shard string, spans string, bands string, hits string, count bigint, word string, _mark string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, "one"), (None, "no id"), (None, None)]
    return spark.createDataFrame([(i, t, 1, "n", "s", "h", "p", "b", "h", 2, "w", "m") for i, t in rows], EXTRA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one"), (2, None), (None, "same text"), (3, "same text of a few words here"), (3, "same text of a few words here"), (4, "..."), (5, "gamma delta " + "alpha beta gamma delta " * 4)], "item_id bigint, text string")


def test_token_counts(odd):
    rows = token_counts.count_tokens(odd).collect()
    assert len(rows) == odd.count()
    slow = packing._tokenizer(packing.default_tokenizer())
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in rows)
    assert got == sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(slow.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_sentencepiece_counts(odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    few = odd.where(F.length(F.coalesce("text", F.lit(""))) < 1000)
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(few, tokenizer_path=path).collect()) == sorted(len(model.encode(r["text"] or "")) for r in few.collect())


def test_long_texts_of_sentencepiece_are_cut_safely():
    import glob
    import os

    import public_tokenizers
    import sentencepiece

    text = "It's a  test, of 12 345 words\n and <s> more \u00fcn\u00ef ones, \u65e5\u672c \ufb01n X1 9y. " * 60
    paths = glob.glob(os.path.join(os.path.dirname(public_tokenizers.path("byte_bpe_50k.json")), "*.model"))
    assert paths
    for path in paths:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        assert token_counts._lengths(path, [text, "", "one"], 100, 1000) == [len(model.encode(t)) for t in (text, "", "one")], path


def test_hilbert_columns_equal_the_index(spark):
    rng = np.random.default_rng(4)
    for dims, bits in ((1, 5), (2, 7), (3, 8), (4, 3)):
        cells = rng.integers(0, 1 << bits, (200, dims))
        df = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(cells)], "i long, " + ", ".join(f"x{d} long" for d in range(dims)))
        got = {r["i"]: r["h"] for r in shards.with_hilbert(df, [f"x{d}" for d in range(dims)], bits, "h").collect()}
        assert [got[i] for i in range(200)] == shards.hilbert_index(cells, bits).tolist()


def test_shards_prune_files(spark, tmp_path):
    """A filter on two dimensions reads fewer shards than it does of shards cut in the order of ids."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    cells = {"lang": shards.category_cell(F.col("lang"), 8), "source": shards.category_cell(F.col("source"), 8), "size": shards.size_cell(F.col("n_chars"), 8)}
    curve = shards.hilbert_shards(docs, cells, ["doc_id"])
    by_id = shards.hilbert_shards(docs, {"one": F.lit(0).cast("long")}, ["doc_id"])
    lang = docs.where("lang is not null").first()["lang"]
    read = {}
    for name, df in (("curve", curve), ("id", by_id)):
        b = shards.shard_bounds(df, ["lang", "n_chars"])
        read[name] = b.where((F.col("min_lang") <= lang) & (F.col("max_lang") >= lang) & (F.col("max_n_chars") >= 2000) & (F.col("min_n_chars") < 4000)).count()
    assert read["id"] >= 35 and read["curve"] <= 12
    shards.write_shards(curve, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 40


def test_shards(spark, odd):
    for rows in (odd, odd.limit(0), odd.limit(3)):
        cells = {"a": shards.category_cell(F.col("word"), 8), "b": shards.size_cell(F.length("text"), 8)}
        # columns called as the outputs are replaced, those called as the operator's own are not
        rows = rows.withColumns({"hilbert": F.lit("old"), "_place": F.lit("kept"), "_position": F.lit("kept"), "c0": F.lit("kept"), "pos": F.lit("kept")})
        out = shards.hilbert_shards(rows, cells, ["doc_id", "text"], shards=4)
        assert sorted(out.columns) == sorted([*rows.columns, "slot"]) and dict(out.dtypes)["shard"] == "int"
        out = out.collect()
        assert len(out) == rows.count() and {r[c] for r in out for c in ("_place", "_position", "c0", "pos")} <= {"kept"}
        counts = [sum(r["shard"] == s for r in out) for s in range(4)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(c)) for s, c in enumerate(counts))


def test_near_duplicates(odd):
    out = neardup.near_duplicates(odd)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert out.count() == odd.count()
    assert got[None] == {None}
    assert got[6] == got[7] == {6} and got[8] == got[9] == {8}
    assert all(got[i] == {i} for i in (0, 1, 2, 3, 4, 5, 10, 11))
    kept = neardup.keep_one(odd).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 5, 6, 8, 10, 11]
    assert sum(r["doc_id"] is None for r in kept) == 2
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_chains_and_repeated_shingles(spark):
    words = [f"w{i}" for i in range(400)]
    rows, text = [], list(words)
    for i in range(12):  # each differs a little from the one before, the ends differ much
        rows.append((i, " ".join(text)))
        text[30 * i : 30 * i + 6] = [f"v{i}{j}" for j in range(6)]
    rows += [(100, "a b c d e f g " * 100), (101, "a b c d e f g " * 90), (102, "a b c d e f g " * 10)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.classes(rows)
    assert got[101] == 100 and got[102] == 102 and got[11] == 0


def test_an_id_with_several_texts(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, one), (1, two), (2, one + " tail"), (3, two + " tail"), (4, None), (4, "x y z"), (5, "X y, z!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(tuple(r) for r in neardup.near_duplicates(df).collect())
    # 1 is in the classes of 2 and of 3, which stay apart; so is 4 in its null text's and in that of 5
    assert out == [(1, 2), (1, 3), (2, 2), (3, 3), (4, 4), (4, 5), (5, 5)]
    kept = sorted((r["doc_id"], r["text"] or "") for r in neardup.keep_one(df).collect())
    assert kept == sorted([(1, one), (1, two), (4, ""), (4, "x y z")])


def test_buckets_that_the_lead_leaves_open(spark):
    """Families around a common core: similar enough to share bands, not all alike; blocks of two make every path run."""
    rng = np.random.default_rng(5)
    core = [f"c{i}" for i in range(300)]
    rows = []
    for family in range(6):
        own = core[:]
        own[20 * family : 20 * family + 12 * (family + 1)] = [f"f{family}x{i}" for i in range(12 * (family + 1))]
        for k in range(5):
            text = own[:]
            at = int(rng.integers(0, 290))
            text[at : at + 3] = [f"v{family}{k}{i}" for i in range(3)]
            rows.append((10 * family + k, " ".join(text)))
    want = brute.classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2, 600):
        got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df, block_docs=block).collect()}
        assert got == want
    assert 1 < len(set(want.values())) < len(rows)


def test_personal_data(spark, odd):
    out = pii.find_personal_data(odd).collect()
    assert len(out) == odd.count()
    assert [(s["kind"], s["start"], s["stop"]) for r in out if r["doc_id"] == 5 for s in r["base"]] == brute.base_spans(TEXTS[5])
    assert pii.find_personal_data(odd.limit(0)).count() == 0
    masked = {r["doc_id"]: r for r in pii.mask_personal_data(odd).collect()}
    assert masked[5]["text"] == "<EMAIL> <PHONE> x" and masked[0]["text"] is None and masked[6]["text"] == LONG
    assert pii.mask_personal_data(odd).columns == odd.columns


HARD = [
    "a.b@c.d_e@f.gh", "x@y.z..q@r.s", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 2 3 4 5 6 7 8 9 +12 ((( +1.2.3)", "é😀a@b.c😀 4111111111111111😀",
    "1" * 30000, "a" * 30000 + "@b.c", "a@" + "b." * 5000, "1 " * 20000, "+1" + "(" * 20000, "@a.b c@.d e@f", "+" * 1000 + "1 23456789", "9-" * 9 + "9 8",
]


def test_hard_texts_match_the_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for r in df.select("doc_id", "text", pii.base_spans(F.col("text")).alias("s")).collect():
        assert [(s["kind"], s["start"], s["stop"]) for s in r["s"]] == brute.base_spans(r["text"]), r["text"][:80]


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"please call me at +1 (743) 555-{1000 + i} today") for i in range(20)]
    rows += [(100, "you can call me at 555-743-9911 today"), (101, "it was made in 1999-12-31 by them"), (102, "nothing to see")]
    out = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[20][1].index("555")
    assert out[100] == [("phone", at, at + 12)] and out[101] == [] and out[102] == []


def test_three_seeds_make_a_pattern(spark):
    rows = [(i, f"please call me at +1 (743) 555-{1000 + i} today") for i in range(3)] + [(100, "you can call me at 555-743-9911 today")]
    out = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s["kind"] for s in out[100]] == ["phone"]


def added(spark, rows):
    out = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    return {r["doc_id"]: [(s["kind"], text[r["doc_id"]][s["start"] : s["stop"]]) for s in r["spans"]] for r in out}


def test_contexts_compete_and_patterns_grow(spark):
    # labels after varying words, at the start of a text, and before brackets
    rows = [(i, f"word{i}x. Phone: +1 743 555-{1000 + i} thing{i}y") for i in range(20)]
    rows += [(50, "Phone: 555-743-9911"), (51, "other. Phone: (555-743-9922) ok")]
    # what a first pattern finds makes a second one, which no seed precedes
    rows += [(200 + i, f"Phone: 743-111-{2000 + i} q{i}a") for i in range(12)] + [(300 + i, f"zz{i}b handset 743-111-{2000 + i}") for i in range(12)]
    rows += [(80, "some handset 743-111-7777"), (81, "it was made in 1999-12-31")]
    out = added(spark, rows)
    assert out[50] == [("phone", "555-743-9911")] and out[51] == [("phone", "555-743-9922")]
    assert out[80] == [("phone", "743-111-7777")] and out[81] == []


def test_candidates_have_the_extent_of_their_kind(spark):
    rows = [(i, f"please call me at +1 743 555 {1000 + i} today") for i in range(20)] + [(30 + i, f"just write to bob{'abcdefghijklmnopqrst'[i]}@corp.com soon") for i in range(20)]
    rows += [(60 + i, f"my card is 4111 1111 1111 {n} ok") for i, n in enumerate(["1111", "1129", "1137", "1145", "1152", "1160", "1178", "1186", "1194"])]
    want = {100: ("phone", "851 555 9673"), 101: ("phone", "(851) 555-9673"), 102: ("email", "bob at corp dot com"), 103: ("email", "eve [at] corp [dot] com"), 104: ("card", "4111 1111 1111 1112")}
    rows += [(100, "call me at 851 555 9673 today"), (101, "call me at (851) 555-9673 today"), (102, "write to bob at corp dot com soon"), (103, "write to eve [at] corp [dot] com"), (104, "the card is 4111 1111 1111 1112 ok")]
    out = added(spark, rows)
    assert {i: out[i] for i in want} == {i: [w] for i, w in want.items()}


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    for y in (labels, labels.limit(0), labels.where("toxic = 0")):
        out = toxicity.score_toxicity(odd, toxicity.fit(odd, y), out_col="score")
        rows = out.collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert out.limit(0).count() == 0


def test_insults_behind_signs():
    lexicon = toxicity.Lexicon()
    at = toxicity.FEATURES.index("unmasked_density")
    for text in ("m0r0n", "a $tup1d one", "1d10t", "so p@thet1c!", "you cl*wn", "L0SER!!"):
        assert toxicity.features(text, lexicon)[at] > 0, text
    for text in ("covid19 in 2024", "10th of 3rd", "great!", "a*b = c", "", "0" * 50_000 + "a1" * 50_000):
        assert toxicity.features(text, lexicon)[at] == 0, text[:40]


def test_calibration_is_there_at_any_size(spark):
    rows = [(i, "you are a vile toad" if i % 2 else f"the house number {i} is blue") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int"))
    assert len(model.knots[0]) > 0
    one = toxicity.fit(docs, spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, toxic int"))
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert one.score(np.zeros((1, len(toxicity.FEATURES))))[0] > 0.9
    assert none.score(np.zeros((1, len(toxicity.FEATURES))))[0] == 0.5


def test_packing(odd):
    rows = packing.pack(odd).collect()
    slow = packing._tokenizer(packing.default_tokenizer())
    want = sum(len(slow.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(r["length"] for r in rows) == want
    null = [r for r in rows if r["doc_id"] == 0]
    assert [(r["length"], r["ids_crc32"]) for r in null] == [(1, zlib.crc32(np.array([0], dtype="<u4").tobytes()))]
    assert packing.pack(odd.limit(0)).count() == 0


def test_decontamination(odd, bench, monkeypatch):
    every = odd.collect()
    want = sorted(brute.decontaminated([r["text"] for r in every], [(r["item_id"], r["text"]) for r in bench.collect()]))
    for size, segment in ((decontaminate.PASS_WINDOWS, decontaminate.SEGMENT), (2, 1)):  # one pass, and several
        monkeypatch.setattr(decontaminate, "SEGMENT", segment)
        out = decontaminate.search_benchmark(odd, bench, pass_windows=size).collect()
        got = sorted((r["n_words"], sum(h["b"] - h["a"] for h in r["hits"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in out)
        assert got == want
    assert decontaminate.search_benchmark(odd, bench.limit(0)).where("size(hits) > 0").count() == 0
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(not w[1] for w in want)


def test_top_k(spark):
    rows = [(i, [float(i % 3), 0.5, -0.25]) for i in range(300)] + [(500, None), (501, [1.0, None, 0.0]), (502, [float("nan"), 1.0, 1.0]), (503, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (600, [1.0, 2.0]), (100, [float(100 % 3), 0.5, -0.25])]
    clash = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("v", "score", "rank", "query_id", "asked")})
    v = topk.quantised(clash, "vec_id", "embedding")
    every = [(r["vec_id"], r["v"]) for r in v.collect()]
    for slice_bytes, sample in ((1 << 20, 100), (60, 0)):
        got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0"), block=16, slice_bytes=slice_bytes, sample_rows=sample).collect()]
        want = []
        for q, x in {(q, tuple(x)) for q, x in every if q % 100 == 0}:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in every if i != q and len(y) == len(x))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert sorted(got) == sorted(want)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_leaves_the_vectors_in_place_and_prunes(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i // 50] + 0.1 * rng.normal(size=16)).tolist()) for i in range(2000)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    plan = topk.top_k(v, v.where("vec_id % 100 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow") and "Exchange" not in plan[plan.index("MapInArrow") :]
    ids, vectors = np.arange(2000), np.array([r["v"] for r in v.orderBy("vec_id").collect()])
    best = topk.Best.none(20, 10)
    scored, met = topk.search_blocks(ids[::100], vectors[::100], np.full(20, np.iinfo(np.int64).min), best, ids, vectors, 50)
    assert scored < 0.5 * met


def test_languages(spark, odd):
    train = spark.createDataFrame([(i, "xx" if i % 2 else "yy", "the house of the king " * 5 if i % 2 else "ñandú corazón después " * 5, "e") for i in range(40)] + [(99, None, "text", "e"), (98, "xx", None, "e")], "doc_id long, lang string, text string, score string")
    model = langid.fit_filters(train)
    out = langid.identify(odd, model, score_out="score").collect()
    assert len(out) == odd.count()
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    none = langid.fit_filters(train.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.predict(model, ["the king of the house"])[0] == ["xx"]
    # chunks change nothing
    whole = langid._hits(model, [LONG])
    langid.CHUNK, before = 1000, langid.CHUNK
    try:
        parts = langid._hits(model, [LONG])
    finally:
        langid.CHUNK = before
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_only_letters_count_as_letters(spark):
    train = spark.createDataFrame([(i, "xx", "the house of the king " * 5) for i in range(9)], "doc_id long, lang string, text string")
    signs = ["\u00b2", "\u00bd", "\u2460", "\u2167", "12 _ \u0660"]
    langs = langid.predict(langid.fit_filters(train), [*signs, "\u00aa", "\u02b0"])[0]
    assert langs == ["und"] * 5 + ["xx"] * 2


def test_more_languages_than_a_word_has_bits(spark):
    rng = np.random.default_rng(3)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(6)] for _ in range(70)]
    train = spark.createDataFrame([(100 * k + i, f"l{k:02}", " ".join(words[k] * 3)) for k in range(70) for i in range(3)], "doc_id long, lang string, text string")
    model = langid.fit_filters(train)
    assert len(model.languages) == 70 and all(t.shape[0] == 2 for t in model.tables)
    assert langid.predict(model, [" ".join(w) for w in words])[0] == [f"l{k:02}" for k in range(70)]


def test_chat(spark):
    texts = ["</s>", "[INST] x [/INST]", "\\b\\l\\o\\n", "a\\", "<", "[", "</s", "\n\n", "", None, "😀 </s>[INST] ok [/INST]", "<<s>", "\\</s>", "\\\\l"]
    rows = [(c, t, role, x, "e") for c, x in enumerate(texts) for t, role in enumerate(["system", "user", "assistant", None, "us\ner", "</s>", "\\n"])]
    rows += [(50, 0, "user", "twice", "e"), (50, 0, "user", "twice", "e"), (51, None, "user", "x", "e"), (None, 1, "assistant", "y", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    out = chat.format_conversations(df).collect()
    assert len(out) == len(texts) + 3
    for r in out:
        own = sorted(((t is not None, t or 0), role or "", x or "") for c, t, role, x, _ in rows if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, x) for _, role, x in own]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert chat.format_conversations(df.limit(0)).count() == 0
