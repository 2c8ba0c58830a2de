"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are folded to words between single blanks, so a window of an item's words
occurs in a document exactly where its bytes occur.  A shift table over blocks
of bytes says how far the search may jump from a position; where it says 0, the
hash of the suffix block selects a bucket of test strings, and direct
comparison confirms.  The search walks many places of a buffer at once, one
numpy lane for each stretch of text.

The tables are built once, on the driver, for a bounded number of windows, and
sized by it; a larger benchmark takes several passes over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.common import in_arrow, materialise, out_batch, table

WINDOW = 10
#: Digits, lower-case letters and every byte of a non-ASCII character stay; A-Z become a-z; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PAD = 16
#: Longest block of the shift table in bytes: about three words, so that blocks of unrelated text are rarely a pattern's.
BLOCK = 16
#: Slots of a shift table for each distinct block, and the least and most bits of a table's size.
SLOTS_PER_BLOCK, LEAST_LOG, MOST_LOG = 12, 16, 26
#: Bytes of the document texts searched at once.
BUFFER = 1 << 22
#: Windows of benchmark text held by one pass over the documents.
PASS_WINDOWS = 1 << 18
#: Windows of one item that stay together.
SEGMENT = 4096


def fold_words(text: str | None) -> bytes:
    """The text's words, lower-cased in A-Z, each between single blanks; b"" where it has none."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    return b" " + b" ".join(words) + b" " if words else b""


def windows(folded: bytes, size: int = WINDOW) -> list[bytes]:
    """The windows of ``size`` consecutive words, or all words where there are fewer."""
    words = folded.split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


def _view(buffer: bytes) -> np.ndarray:
    """Little-endian 8-byte words at every offset of ``buffer`` but its last 7."""
    raw = np.frombuffer(buffer, dtype=np.uint8)
    return np.ndarray((max(0, len(raw) - 7),), dtype="<u8", buffer=raw, strides=(1,))


@dataclass
class PatternTable:
    """Shift and bucket tables over patterns that are at least ``least`` bytes long."""

    least: int
    block: int
    log: int
    shift: np.ndarray
    starts: np.ndarray  # by the hash of the first bytes: can a pattern start so
    buckets: dict[int, dict[bytes, int]]  # by the slot of the suffix block
    words: list[int]  # the numbers of words that patterns have

    def slots(self, view: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of the blocks that end before each of ``ends``: of their first and last 8 bytes, or all where they are fewer."""
        if self.block <= 8:
            mixed = (view[ends - self.block] & np.uint64((1 << 8 * self.block) - 1)) * _MIX
        else:
            mixed = (view[ends - self.block] * _MIX ^ (view[ends - 8] + _MIX) * _MIX2) * _MIX
        return mixed >> np.uint64(64 - self.log)

    def heads(self, view: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Slots of the first bytes at each of ``at``."""
        return ((view[at] & np.uint64((1 << 8 * min(8, self.least)) - 1)) * _MIX2) >> np.uint64(64 - self.log)


def build_table(patterns: list[tuple[bytes, int]], least: int) -> PatternTable:
    block = min(BLOCK, max(1, least // 2))
    data = b"".join(p[:least] for p, _ in patterns) + b"\0" * _PAD
    view = _view(data)
    base = np.arange(len(patterns)) * least
    # neighbouring windows share their text, so there are about as many blocks as bytes, not bytes times windows
    places = np.concatenate([base + end for end in range(block, least + 1)])
    probe = PatternTable(least, block, 62, np.zeros(0), np.zeros(0), {}, [])
    distinct = len(np.unique(probe.slots(view, places)))
    log = min(MOST_LOG, max(LEAST_LOG, math.ceil(math.log2(SLOTS_PER_BLOCK * distinct))))
    kind = np.uint8 if least - block + 1 < 256 else np.int32
    out = PatternTable(least, block, log, np.full(1 << log, least - block + 1, dtype=kind), np.zeros(1 << log, dtype=bool), {}, sorted({p.count(b" ") - 1 for p, _ in patterns}))
    for end in range(block, least + 1):  # from long jumps to none, so the shortest of a slot stays
        out.shift[out.slots(view, base + end)] = least - end
    for slot, (pattern, number) in zip(out.slots(view, base + least).tolist(), patterns, strict=True):
        out.buckets.setdefault(slot, {})[pattern] = number
    out.starts[out.heads(view, base)] = True
    return out


@dataclass
class Searcher:
    """Tables by class of pattern length; item ids and word counts by pattern."""

    tables: list[PatternTable]
    words: list[int]
    items: list[tuple[int, ...]]

    @classmethod
    def of(cls, benchmark: list[tuple[object, list[bytes]]]) -> Searcher:
        """For (item id, windows) pairs."""
        ids: dict[bytes, set] = {}
        for item, held in benchmark:
            for w in held:
                ids.setdefault(w, set()).add(item)
        every = sorted(ids)
        number = {w: i for i, w in enumerate(every)}
        classes: dict[int, list[bytes]] = {}
        for w in every:  # short patterns would shorten the jumps of long ones
            classes.setdefault(min(6, len(w).bit_length()), []).append(w)
        tables = [build_table([(w, number[w]) for w in ws], min(map(len, ws))) for ws in classes.values()]
        return cls(tables, [w.count(b" ") - 1 for w in every], [tuple(ids[w]) for w in every])

    def find(self, buffer: bytes) -> list[tuple[int, int]]:
        """(offset, pattern) of every occurrence in ``buffer``, which consists of folded texts."""
        found: list[tuple[int, int]] = []
        view = _view(buffer + b"\0" * _PAD)
        blank = np.frombuffer(buffer, dtype=np.uint8) == 32
        blanks = np.flatnonzero(blank)
        for t in self.tables:
            if len(buffer) < t.least:
                continue
            stretch = max(256, 8 * t.least)
            # a lane owns the prefix ends in its stretch
            ends = np.arange(t.least, len(buffer) + 1, stretch)
            last = np.minimum(ends + stretch, len(buffer) + 1)
            while len(ends):
                slot = t.slots(view, ends)
                step = t.shift[slot].astype(np.int64)
                hit = np.flatnonzero(step == 0)
                if len(hit):
                    at = ends[hit] - t.least
                    ok = np.flatnonzero(blank[at])
                    ok = ok[t.starts[t.heads(view, at[ok])]]
                    first = np.searchsorted(blanks, at[ok])
                    for offset, s, w in zip(at[ok].tolist(), slot[hit][ok].tolist(), first.tolist(), strict=True):
                        bucket = t.buckets.get(s)
                        if bucket is None:
                            continue
                        # only the text's own window of as many words can be a bucket's string
                        for k in t.words:
                            if w + k < len(blanks) and (number := bucket.get(buffer[offset : blanks[w + k] + 1])) is not None:
                                found.append((offset, number))
                    step = np.maximum(step, 1)
                ends = ends + step
                live = ends < last
                if not live.all():
                    ends, last = ends[live], last[live]
        return found


def _scan(searcher: Searcher, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set]]:
    """Words, hit word ranges and occurring items of each text."""
    n_words, ranges, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal parts, owners, size
        buffer = b"".join(parts)
        bases = np.cumsum([0] + [len(p) for p in parts])
        found = searcher.find(buffer)
        if found:
            blanks = np.flatnonzero(np.frombuffer(buffer, dtype=np.uint8) == 32)
            offsets = np.array([x[0] for x in found])
            part = np.searchsorted(bases, offsets, side="right") - 1
            word = np.searchsorted(blanks, offsets) - np.searchsorted(blanks, bases[part])
            for k, (w, (_, number)) in zip(part.tolist(), zip(word.tolist(), found, strict=True), strict=True):
                ranges[owners[k]].append((w, w + searcher.words[number]))
                items[owners[k]].update(searcher.items[number])
        parts, owners, size = [], [], 0

    for i, t in enumerate(texts):
        f = fold_words(t)
        if f:
            n_words[i] = f.count(b" ") - 1
            parts.append(f)
            owners.append(i)
            size += len(f)
            if size >= BUFFER:
                flush()
    if parts:
        flush()
    return n_words, ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def benchmark_passes(benchmark: DataFrame, item_col: str, text_col: str, window: int, pass_windows: int) -> Iterator[Broadcast]:
    """Searchers for all windows of the benchmark, ``pass_windows`` or so in each.

    Items are cut into segments of ``SEGMENT`` windows, whose neighbours overlap
    by all but one word of a window, and the segments are dealt to the passes.
    """
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    schema = pa.schema([("item", pa.string()), ("segment", pa.int64()), ("folded", pa.binary()), ("n", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = fold_words(text).split()
                n = max(1, len(words) - window + 1)
                rows += [(item, a, b" " + b" ".join(words[a : min(n, a + SEGMENT) + window - 1]) + b" ", min(n, a + SEGMENT) - a) for a in range(0, n, SEGMENT) if words]
            yield out_batch(schema, **{c: [r[i] for r in rows] for i, c in enumerate(schema.names)})

    parts = materialise(in_arrow(bench, cut, "item string, segment bigint, folded binary, n bigint"), "benchmark_segments")
    passes = max(1, -(-(parts.agg(F.sum("n")).first()[0] or 0) // pass_windows))
    for k in range(passes):
        rows = parts.where(F.pmod(F.xxhash64("item", "segment"), F.lit(passes)) == k).select("item", "folded").collect()  # about pass_windows windows
        yield spark.sparkContext.broadcast(Searcher.of([(r["item"], windows(bytes(r["folded"]), window)) for r in rows]))


def search_benchmark(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """One row per input row: id, text, ``n_words``, ``hits`` (merged word ranges) and ``items`` (occurring item ids, as strings).

    A null text has no words.  Items with a null id or without words take no
    part; repeated items count once.  The benchmark goes to the executors in
    parts of ``pass_windows`` or so, one pass over the documents for each, so
    its size is bounded whatever it grows to.
    """
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), empty.alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    for shared in benchmark_passes(benchmark, item_col, item_text_col, window, pass_windows):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n_words, ranges, items = _scan(shared.value, b.column("text").to_pylist())
                hits = b.column("hits").to_pylist()
                before = b.column("items").to_pylist()
                hits = [[{"a": x, "b": y} for x, y in merged([(h["a"], h["b"]) for h in old] + new)] for old, new in zip(hits, ranges, strict=True)]
                items = [sorted({*old, *new}) for old, new in zip(before, items, strict=True)]
                yield out_batch(b.schema, id=b.column("id"), text=b.column("text"), n_words=n_words, hits=hits, items=items)

        out = in_arrow(out, run, schema)
    return out.withColumnRenamed("id", id_col)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside any ten-word window of a ``benchmark`` item."""
    found = search_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """The rows of ``df`` without a window of any item; nothing else changes.

    Null texts and texts without words stay.  The search stops at nothing: each
    whole text is read, in one pass for each ``pass_windows`` of the benchmark.
    """
    schema = df.schema
    for shared in benchmark_passes(benchmark, item_col, item_text_col, window, pass_windows):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, ranges, _ = _scan(shared.value, b.column(text_col).to_pylist())
                yield b.filter(pa.array([not r for r in ranges], pa.bool_()))

        df = in_arrow(df, run, schema)
    return df
