"""Token counts: batch encoding in an Arrow function that returns lengths only.

Batches are balanced by bytes, and a long text is cut where the tokenizer's
own pre-tokenisation cuts it in any case, so its count stays exact.  Texts of
plain characters are encoded by the merge ranks of the same vocabulary file,
which gives the same ids several times as fast; all others by the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.common import byte_runs, in_arrow, out_batch, table

#: A single blank between two letters or digits ends a pre-token of byte-level
#: BPE and belongs to the next one, so a cut before it changes no token.
SAFE_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
#: The same between ASCII characters only, which no normaliser of a ``.model`` file changes.
ASCII_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task owns one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _sentencepiece(path: str):
    """The processor, and whether its texts can be cut before a blank.

    They can if no piece goes on behind a blank and the blank at the head of a
    cut piece counts as the one between words.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inside = any("\u2581" in model.id_to_piece(i)[1:].lstrip("\u2581") for i in range(model.get_piece_size()))
    same = all(model.encode(f"{a} {b}") == model.encode(a) + model.encode(f" {b}") for a, b in (("word", "next"), ("X1", "9y"), ("a", "b c d")))
    return model, same and not inside


#: Texts of these characters only are cut into pre-tokens alike by both encoders, whatever Unicode version each has.
PLAIN = re.compile(r"[\t\n\r -~¡-ɏ‐-‧€]*\Z")
#: Longest text without a safe boundary that the rank encoder is given.
LONGEST = 1 << 15


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE vocabularies use, by byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in printable]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


def is_plain(text: str) -> bool:
    """May the rank encoder be given this text?"""
    return len(text) < 4 * LONGEST and PLAIN.match(text) is not None


@lru_cache(maxsize=2)
def rank_encoder(path: str):
    """An encoder by merge ranks with the same vocabulary file as ``tokenizers``; several times as fast.

    Only for byte-level BPE files whose ids follow the merge order; None for any other.
    """
    import public_tokenizers
    import tiktoken

    spec = json.loads(open(path, encoding="utf-8").read())
    if spec["model"].get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        return None
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    vocab = spec["model"]["vocab"]
    ids = [vocab[m.replace(" ", "")] for m in merges]
    if ids != sorted(ids):
        return None
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def by_ranks(path: str) -> bool:
    """Does a vocabulary file have a rank encoder, and do its ids equal the library's on a few probes?

    Asked once, on the driver: the tasks then load the library only for texts that need it.
    """
    fast = None if path.endswith(".model") else rank_encoder(path)
    if fast is None:
        return False
    probes = ["", " ", "Word", " word  two\n\n three\t", "it's we'll 12 345,67", "\u00fcn\u00ef \u00d8\u2026\u201cq\u201d"]
    probes += [x for t in fast.special_tokens_set for x in (t, f"a{t}b", f" a {t} b")]
    return all(fast.encode(p, allowed_special="all") == _tokenizer(path).encode(p, add_special_tokens=False).ids for p in probes)


def safe_pieces(text: str, limit: int, boundary: re.Pattern = SAFE_CUT) -> list[str]:
    """``text`` cut at safe boundaries into pieces of about ``limit`` characters.

    Where no safe boundary follows, the rest stays one piece.
    """
    pieces, start = [], 0
    while len(text) - start > limit:
        cut = boundary.search(text, start + limit)
        if cut is None:
            break
        pieces.append(text[start : cut.start()])
        start = cut.start()
    pieces.append(text[start:])
    return pieces


def _lengths(path: str, texts: list[str], piece_chars: int, batch_bytes: int, ranked: bool = False) -> list[int]:
    counts = [0] * len(texts)
    if path.endswith(".model"):
        model, divisible = _sentencepiece(path)
        fast, cut = None, (lambda t: safe_pieces(t, piece_chars, ASCII_CUT)) if divisible else (lambda t: [t])
        encode = lambda part: model.encode(part, num_threads=1)
    else:
        fast, cut = rank_encoder(path) if ranked else None, lambda t: safe_pieces(t, min(piece_chars, LONGEST))
        encode = lambda part: _tokenizer(path).encode_batch_fast(part, add_special_tokens=False)
    pieces, owner = [], []
    for i, t in enumerate(texts):
        for p in cut(t):
            if fast is not None and is_plain(p):
                counts[i] += len(fast.encode_to_numpy(p, allowed_special="all"))
            else:
                pieces.append(p)
                owner.append(i)
    for a, b in byte_runs((len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in pieces), batch_bytes):
        for i, x in zip(owner[a:b], encode(pieces[a:b]), strict=True):
            counts[i] += len(x)
    return counts


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, limit: int = 512, piece_chars: int = 1 << 16, batch_bytes: int = 1 << 19
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    A null text counts as empty: 0 bytes, 0 tokens.  Rows with a null id and
    repeated rows are counted like any other; other columns are not read.
    ``piece_chars`` bounds a piece of a long text, ``batch_bytes`` a call of the
    tokenizer; neither changes a count.
    """
    path = tokenizer_path or default_tokenizer()
    ranked = by_ranks(path)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = _lengths(path, b.column("text").to_pylist(), piece_chars, batch_bytes, ranked)
            ids = b.column("id")
            schema = pa.schema([("id", ids.type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
            yield out_batch(schema, id=ids, n_bytes=b.column("n_bytes"), n_tokens=counts)

    out = in_arrow(rows, run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return count_tokens(table(spark, sf_dir, "documents"))
