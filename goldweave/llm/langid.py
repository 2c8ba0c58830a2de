"""Language ID with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, per slot, one bit for every language, in as many
words of 64 bits as the languages need; the AND
of an n-gram's slots is the set of all languages that contain it.  A document's
languages are scored by the share of its n-grams that each contains, corrected
for the filter's false positives, and the highest corrected share decides.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from goldweave.llm.common import in_arrow, out_batch, table

_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text handled at once; longer texts go in overlapping chunks.
CHUNK = 1 << 20


def folded(text: str) -> bytes:
    """Lower-cased UTF-8 with ASCII letters and all non-ASCII bytes kept, the rest blank, between blanks."""
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" "


def grams(buffer: np.ndarray, n: int) -> np.ndarray:
    """The n-grams (n bytes, n <= 7) at every position, tagged with n."""
    size = len(buffer) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(size, n, dtype=np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | buffer[i : i + size].astype(np.uint64)
    return out


def slots(gram: np.ndarray, probes: int, log_slots: int) -> list[np.ndarray]:
    """Slots of each n-gram by double hashing."""
    mixed = gram * _M1
    mixed ^= mixed >> np.uint64(32)
    mixed *= _M2
    first, second = mixed >> np.uint64(33), (mixed & np.uint64(0x7FFFFFFF)) | np.uint64(1)
    mask = np.uint64((1 << log_slots) - 1)
    return [(first + np.uint64(i) * second) & mask for i in range(probes)]


@dataclass(frozen=True)
class Filters:
    """Bit-sliced Bloom filters of all languages, one table (word of 64 languages, slot) for each n."""

    languages: tuple[str, ...]
    sizes: tuple[int, ...]
    probes: int
    log_slots: int
    tables: tuple[np.ndarray, ...]
    expected: np.ndarray  # (n, language): corrected share that the language's own text has

    def false_positive(self, t: np.ndarray) -> np.ndarray:
        fill = np.array([np.count_nonzero(t[b // 64] & t.dtype.type(1 << b % 64)) / t.shape[1] for b in range(len(self.languages))])
        return fill**self.probes


def build_filters(counts: list[tuple[str, int]], languages: tuple[str, ...], sizes: tuple[int, ...], probes: int, log_slots: int) -> Filters:
    """``counts``: (language, tagged n-gram) pairs to insert."""
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.iinfo(k).bits), np.uint64)  # a small table stays in the cache
    tables = [np.zeros((-(-len(languages) // 64), 1 << log_slots), dtype=kind) for _ in sizes]
    bit = {lang: (i // 64, kind(1 << i % 64)) for i, lang in enumerate(languages)}
    by: dict[tuple[str, int], list[int]] = {}
    for lang, g in counts:
        n = (int(g).bit_length() - 1) // 8  # the tag stands above n bytes
        by.setdefault((lang, n), []).append(g)
    for (lang, n), gs in by.items():
        for at in slots(np.array(gs, dtype=np.uint64), probes, log_slots):
            np.bitwise_or.at(tables[sizes.index(n)][bit[lang][0]], at, bit[lang][1])
    return Filters(languages, sizes, probes, log_slots, tuple(tables), np.ones((len(sizes), len(languages))))


def _hits(model: Filters, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hits (text, n, language) and n-grams (text, n); whole texts, chunk by chunk."""
    hits = np.zeros((len(texts), len(model.sizes), len(model.languages)))
    total = np.zeros((len(texts), len(model.sizes)))
    parts: list[bytes] = []
    owners: list[int] = []
    limits: list[int] = []
    overlap, size = max(model.sizes) - 1, 0

    def flush() -> None:
        nonlocal parts, owners, limits, size
        buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        own, limit = np.array(owners), np.array(limits)
        for k, n in enumerate(model.sizes):
            gram = grams(buffer, n)
            places = slots(gram, model.probes, model.log_slots)
            # windows that begin with two blanks say nothing about a language; a part's windows end inside it
            first = np.minimum(starts, len(gram))
            last = np.maximum(np.minimum(np.minimum(ends - n + 1, starts + limit), len(gram)), first)
            solid = (buffer[: len(gram)] != 32) | (buffer[1 : len(gram) + 1] != 32)
            sums = np.concatenate(([0], np.cumsum(solid)))
            np.add.at(total[:, k], own, sums[last] - sums[first])
            for w, table in enumerate(model.tables[k]):
                mask = None
                for at in places:
                    found = table[at]
                    mask = found if mask is None else mask & found
                mask = np.where(solid, mask, table.dtype.type(0))
                for b in range(min(64, len(model.languages) - 64 * w)):
                    sums = np.concatenate(([0], np.cumsum((mask & table.dtype.type(1 << b)) != 0, dtype=np.int64)))
                    np.add.at(hits[:, k, 64 * w + b], own, sums[last] - sums[first])
        parts, owners, limits, size = [], [], [], 0

    for i, t in enumerate(texts):
        data = folded(t)
        cuts = range(0, max(1, len(data) - overlap), CHUNK)
        for a in cuts:  # a chunk's windows begin in it and may end in the next
            parts.append(data[a : a + CHUNK + overlap])
            owners.append(i)
            limits.append(CHUNK if a != cuts[-1] else CHUNK + overlap)
            size += len(parts[-1])
            if size >= CHUNK:
                flush()
    if parts:
        flush()
    return hits, total


def shares(model: Filters, texts: list[str]) -> np.ndarray:
    """Corrected share of contained n-grams, shape (text, n, language)."""
    hits, total = _hits(model, texts)
    raw = hits / np.maximum(total, 1)[:, :, None]
    wrong = np.stack([model.false_positive(t) for t in model.tables])[None]
    return np.clip((raw - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1)


def predict(model: Filters, texts: list[str | None], sharpness: float = 12.0) -> tuple[list[str], list[float], list[float]]:
    """Language, score and recognised share of each text; ``und``, 0 and 0 where a text is null or has no letter (Unicode category L).

    The recognised share is the best language's corrected share of the text's
    n-grams, as a part of what its own texts have; the score is that share (1 at
    most) times the best language's lead over the others.
    """
    known = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    share = shares(model, [t if k else "" for t, k in zip(texts, known, strict=True)])
    fit = (share / np.maximum(model.expected, 1e-3)[None]).mean(axis=1)
    best = fit.argmax(axis=1)
    weight = np.exp(sharpness * (fit - fit.max(axis=1, keepdims=True)))
    recognised = np.minimum(1, fit.max(axis=1))
    score = weight.max(axis=1) / weight.sum(axis=1) * recognised
    return [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], *([float(x) if k else 0.0 for x, k in zip(xs, known, strict=True)] for xs in (score, recognised))


def fit_filters(
    train: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", per_language: int = 1500, sizes: tuple[int, ...] = (3, 5), grams_per_language: int = 12_000, probes: int = 3, log_slots: int = 18, seed: str = "langid"
) -> Filters:
    """Fit on about ``per_language`` whole texts of each language, chosen by a hash of the row's id.

    The bound is on the sample of each language, whatever the corpus size:
    ``grams_per_language`` n-grams of each length.  All languages are learned.
    Rows with a null text or language take no part.
    """
    rows = train.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = sorted(((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()), key=lambda x: x[0])
    languages = tuple(x[0] for x in counts)
    if not languages:
        return Filters((), sizes, probes, log_slots, tuple(np.zeros((0, 1 << log_slots), dtype=np.uint64) for _ in sizes), np.ones((len(sizes), 0)))
    # learned languages can be many, so the shares are one map literal and not an expression for each
    share = F.from_json(F.lit(json.dumps({lang: min(1.0, per_language / n) for lang, n in counts})), "map<string,double>")
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("gram", pa.int64()), ("c", pa.int64())])
        for b in batches:
            langs, texts = np.array(b.column("lang").to_pylist(), dtype=object), b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                for n in sizes:
                    held: dict[int, int] = {}
                    part, size = [], 0
                    own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                    for i, t in enumerate(own):
                        part.append(folded(t))
                        size += len(t)
                        if size > CHUNK or i == len(own) - 1:
                            g, c = np.unique(grams(np.frombuffer(b"".join(part), dtype=np.uint8), n), return_counts=True)
                            for x, y in zip(g.tolist(), c.tolist(), strict=True):
                                held[x] = held.get(x, 0) + y
                            part, size = [], 0
                    if held:
                        yield out_batch(schema, lang=[lang] * len(held), n=[n] * len(held), gram=list(held), c=list(held.values()))

    counted = in_arrow(sample, count, "lang string, n int, gram bigint, c bigint").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    top = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram")
    kept = counted.where("c > 2").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= grams_per_language)
    pairs = [(r["lang"], r["gram"]) for r in kept.select("lang", "gram").collect()]
    model = build_filters(pairs, languages, sizes, probes, log_slots)

    def own_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("share", pa.float64())])
        for b in batches:
            langs = b.column("lang").to_pylist()
            s = shares(model, b.column("text").to_pylist())
            for k in range(len(sizes)):
                yield out_batch(schema, lang=langs, n=[k] * len(langs), share=[float(s[i, k, languages.index(x)]) for i, x in enumerate(langs)])

    expected = np.ones((len(sizes), len(languages)))
    for r in in_arrow(sample, own_share, "lang string, n int, share double").groupBy("lang", "n").agg(F.percentile_approx("share", 0.5).alias("share")).collect():
        expected[r["n"], languages.index(r["lang"])] = r["share"]
    return Filters(languages, sizes, probes, log_slots, model.tables, expected)


def held_out(id_col: str = "doc_id"):
    """True for the rows that no model may learn from: CRC-32 of the id as text leaves 2 of 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(df: DataFrame, model: Filters, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score", share_out: str = "lang_share") -> DataFrame:
    """``df`` with the predicted language, a score from 0 to 1 and the recognised share of n-grams (see ``predict``); every row stays.

    A null text or one without a letter is ``und`` with score and share 0.  With
    no learned language every text is ``und``.  Existing columns named as the
    outputs are replaced.
    """
    df = df.drop(lang_out, score_out, share_out)
    schema = T.StructType([*df.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType()), T.StructField(share_out, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # 8 bytes x 2**log_slots for each n and 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(text_col).to_pylist()
            langs, score, share = predict(m, texts) if m.languages else (["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], names=[*b.schema.names, lang_out, score_out, share_out])

    return in_arrow(df, run, schema)


def op10_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_filters(docs.where(~held_out()))
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, score_out="score")
    return out.select("doc_id", "held_out", "lang_pred", "score")
