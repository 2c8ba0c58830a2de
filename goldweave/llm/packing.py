"""Packing along a space-filling curve.

A document's hashed token vector is projected to a few dimensions, the
documents are range-sorted by the Hilbert key of the quantised projection, and
neighbours along the curve share sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.common import in_arrow, materialise, table
from goldweave.llm.shards import hilbert_index
from goldweave.llm.token_counts import LONGEST, _tokenizer, by_ranks, default_tokenizer, is_plain, rank_encoder, safe_pieces

SEQUENCE = 1024
DIMENSIONS = 3
BITS = 6
def encode(texts: list[str], path: str, ranked: bool) -> list[np.ndarray]:
    """Ids as ``tokenizers`` gives them, without added special tokens.

    Plain texts go through the rank encoder; other characters and very long
    texts without a boundary, and all where the file isn't ``ranked``, go through
    ``tokenizers`` itself.
    """
    fast = rank_encoder(path) if ranked else None
    out = []
    for t in texts:
        parts = []
        for p in safe_pieces(t, LONGEST):
            if fast is not None and is_plain(p):
                parts.append(fast.encode_to_numpy(p, allowed_special="all"))
            else:
                parts.append(np.array(_tokenizer(path).encode(p, add_special_tokens=False).ids, dtype=np.uint32))
        out.append((parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False))
    return out


@lru_cache(maxsize=2)
def _signs(dimensions: int) -> np.ndarray:
    """Feature hashing of token ids: a +1 or -1 for each dimension and id (ids fold at 2**17)."""
    ids = np.arange(1 << 17, dtype=np.uint64)
    out = np.empty((dimensions, len(ids)), dtype=np.float32)
    for d in range(dimensions):
        x = (ids + np.uint64(d * 0x51ED2701 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[d] = np.where(x >> np.uint64(63) == 1, 1.0, -1.0)
    return out


def document_pieces(df: DataFrame, path: str, id_col: str, text_col: str, eos: int = 0) -> DataFrame:
    """One row per document: id, ``tokens``, its pieces (start, length, ids_crc32) and its projection.

    A document is cut at multiples of the sequence length, so all but its last
    piece fill a sequence.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ranked = by_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _signs(DIMENSIONS)
        for b in batches:
            pieces, tokens, place = [], [], []
            for ids in encode(b.column("text").to_pylist(), path, ranked):
                place.append([float(signs[d][ids & 0x1FFFF].mean()) if len(ids) else 0.0 for d in range(DIMENSIONS)])
                ids = np.append(ids, np.uint32(eos)).astype("<u4")
                tokens.append(len(ids))
                pieces.append([{"start": s, "length": len(x), "ids_crc32": zlib.crc32(x.tobytes())} for s in range(0, len(ids), SEQUENCE) if len(x := ids[s : s + SEQUENCE])])
            piece = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(tokens, pa.int64()), pa.array(pieces, piece), pa.array(place, pa.list_(pa.float64()))], names=["id", "tokens", "pieces", "place"])

    return in_arrow(rows, run, f"id {kind}, tokens bigint, pieces array<struct<start:bigint,length:bigint,ids_crc32:bigint>>, place array<double>")


class BestFit:
    """Open sequences by free space; the fullest closes when more than ``most`` are open."""

    def __init__(self, first_id: int, most: int):
        self.next_id, self.most = first_id, most
        self.free: list[list[int]] = [[] for _ in range(SEQUENCE + 1)]
        self.mask = self.count = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        fitting = self.mask >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            seq = self._take(space)
        else:
            seq, space = self.next_id, SEQUENCE
            self.next_id += 1
        left = space - length
        if left:
            self.free[left].append(seq)
            self.mask |= 1 << left
            self.count += 1
            if self.count > self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
        return seq, SEQUENCE - space

    def _take(self, space: int) -> int:
        seq = self.free[space].pop(0)
        self.count -= 1
        if not self.free[space]:
            self.mask &= ~(1 << space)
        return seq


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, open_sequences: int = 256, docs_per_range: int = 20_000) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and gives one piece, its end token.  Repeated rows are
    packed each; equal projections are ordered by id, so a hot vector spreads
    over ranges.  An empty table gives no rows.
    """
    path = tokenizer_path or default_tokenizer()
    spark = df.sparkSession
    docs = materialise(document_pieces(df, path, id_col, text_col), "pieces")
    cuts = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    stats = docs.agg(F.count("*").alias("n"), *[F.percentile_approx(F.col("place")[d], cuts, 1000).alias(f"q{d}") for d in range(DIMENSIONS)]).first()
    bounds = [np.unique(np.array(stats[f"q{d}"] or [], dtype=np.float64)) for d in range(DIMENSIONS)]

    @F.pandas_udf("long")
    def key(place: pd.Series) -> pd.Series:
        if not len(place):
            return pd.Series([], dtype="int64")
        xs = np.stack(place.to_numpy())
        cells = np.stack([np.searchsorted(bounds[d], xs[:, d]) for d in range(DIMENSIONS)], axis=1)
        return pd.Series(hilbert_index(cells, BITS).astype(np.int64))

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), stats["n"] // docs_per_range), stats["n"] // (50 * docs_per_range))
    ranged = docs.select("id", "tokens", "pieces", key("place").alias("curve")).repartitionByRange(parts, "curve", "id", "tokens").sortWithinPartitions("curve", "id", "tokens")
    kind = docs.schema["id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(TaskContext.get().partitionId() << 40, open_sequences)
        for b in batches:
            ids, columns = [], {n: [] for n in names}
            for i, (tokens, pieces) in enumerate(zip(b.column("tokens").to_pylist(), b.column("pieces").to_pylist(), strict=True)):
                for p in pieces:
                    seq, offset = bins.place(p["length"])
                    ids.append(i)
                    for n, v in zip(names, (p["start"], p["length"], p["ids_crc32"], tokens, seq, offset), strict=True):
                        columns[n].append(v)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ids, pa.int64())), *[pa.array(columns[n], pa.int64()) for n in names]], names=["id", *names])

    packed = in_arrow(ranged, run, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names))
    return packed.withColumnRenamed("id", id_col)


def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
