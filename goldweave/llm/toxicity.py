"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed seed lexicon and of a lexicon learned from the
labelled rows (words and word beginnings, by log-odds), closeness to the second
person, capitals, punctuation, and obfuscated spellings.  The trees are fitted
on the driver on a bounded sample of labelled rows and calibrated by isotonic
regression on cross-fitted margins; scoring is one Arrow pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldweave.llm.common import in_arrow, out_batch, table
from goldweave.llm.langid import held_out

#: Common insults in English, a start where few labels exist.
INSULTS = "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown garbage fool imbecile jerk".split()
#: Second-person words.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tus usted ustedes vuestro".split()
#: Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = ("log_words", "seed_density", "learned_density", "learned_hits", "learned_best", "near_second", "second_density", "capitals", "shouted", "exclaimed", "punctuated", "obfuscated", "unmasked_density")
#: Word beginnings that can be learned, in bytes of UTF-8.
PREFIXES = (4, 5, 6, 8)
NEAR = 5
#: Parts of the cross-fit.
FOLDS = 5
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else b if b == 39 else 32 for b in range(256))
_SEEDS = frozenset(w.encode() for w in INSULTS)
_SECOND = frozenset(w.encode() for w in SECOND_PERSON)
#: A whole run of letters with signs among or before them; starts at the run's edge and never backtracks, so very long runs take linear time.
_ODD = re.compile(r"(?<![^\W_])(?<![@$*])[^\W\d_]*+(?:[0-9@$!*]++[^\W\d_]++)++[0-9@$]*+")
_UPPER = re.compile(r"\b[A-ZÀ-ÞĀ-Ž]{3,}\b")
_UNMASK = str.maketrans(LOOKALIKES)
_UPPER_BYTES = bytes(range(65, 91))
_LETTER_BYTES = bytes([*range(65, 91), *range(97, 123)])
_MARKS = b"!?"
_OTHER_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b"!?.,'")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def forms(word: bytes) -> list[bytes]:
    """A word, and its beginnings marked with a star."""
    return [word, *[word[:n] + b"*" for n in PREFIXES if len(word) > n]]


@dataclass
class Lexicon:
    """Learned forms: counts in toxic and clean texts of the sample."""

    toxic: int = 0
    clean: int = 0
    counts: dict[bytes, tuple[int, int]] = field(default_factory=dict)

    def weight(self, form: bytes) -> float:
        """Log-odds of a form."""
        pos, neg = self.counts.get(form, (0, 0))
        if pos < 1:
            return 0.0
        return max(0.0, math.log((pos + 0.5) / (self.toxic + 1)) - math.log((neg + 0.5) / (self.clean + 1)))

    def without(self, toxic: int, clean: int, counts: dict[bytes, tuple[int, int]]) -> Lexicon:
        """The lexicon as learned without some of its texts."""
        less = {f: (pos - counts.get(f, (0, 0))[0], neg - counts.get(f, (0, 0))[1]) for f, (pos, neg) in self.counts.items()}
        return Lexicon(self.toxic - toxic, self.clean - clean, less)

    def __post_init__(self) -> None:
        self.stems = {f[:4] for f in self.counts}
        self.cache: dict[bytes, float] = {}

    def word_weight(self, word: bytes) -> float:
        w = self.cache.get(word)
        if w is None:
            w = max(self.weight(f) for f in forms(word))
            if len(self.cache) < 200_000:
                self.cache[word] = w
        return w


def unmasked(run: str, lexicon: Lexicon) -> bool:
    """Is a run of letters and signs an insult once its signs are read as letters, a star as any?"""
    word = run.lower().translate(_UNMASK)
    if "*" in word:
        return any(len(s) == len(word) and all(c in ("*", x) for c, x in zip(word, s, strict=True)) for s in INSULTS)
    return (plain := word.encode()) in _SEEDS or plain in lexicon.counts


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The features of one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    words = words_of(text)
    n = max(1, len(words))
    stems, weigh = lexicon.stems, lexicon.word_weight
    learned: dict[int, float] = {i: w for i, x in enumerate(words) if x[:4] in stems and (w := weigh(x)) > 0}
    seeds = [i for i, x in enumerate(words) if x in _SEEDS]
    second = [i for i, x in enumerate(words) if x in _SECOND]
    hits = sorted({*learned, *seeds})
    near = 0
    if hits and second:
        at = np.searchsorted(second, hits)
        places = np.array(second)
        left = np.abs(np.array(hits) - places[np.maximum(at - 1, 0)])
        right = np.abs(places[np.minimum(at, len(second) - 1)] - np.array(hits))
        near = int((np.minimum(left, right) <= NEAR).sum())
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    count = lambda keep: size - len(raw.translate(None, keep))
    odd = _ODD.findall(text)
    read = sum(unmasked(x, lexicon) for x in odd)
    letters = count(_LETTER_BYTES)
    return [
        math.log1p(len(words)),
        len(seeds) / n,
        sum(learned.values()) / n,
        math.log1p(len(learned)),
        max(learned.values(), default=0.0),
        near / max(1, len(hits)),
        len(second) / n,
        count(_UPPER_BYTES) / max(1, letters),
        len(_UPPER.findall(text)) / n,
        count(_MARKS) / n,
        count(_OTHER_MARKS) / n,
        len(odd) / n,
        read / n,
    ]


@dataclass
class Trees:
    """Gradient-boosted regression trees for logistic loss, as flat arrays; one row per tree."""

    base: float
    split: list[np.ndarray]  # feature of each inner node, in heap order
    at: list[np.ndarray]  # threshold of each inner node: right if above
    leaf: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for split, at, leaf in zip(self.split, self.at, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(split) and node[0] < len(split):
                node = 2 * node + 1 + (x[rows, split[node]] > at[node])
            out += leaf[node - len(split)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 3.0, ridge: float = 1.0) -> Trees:
    """Histogram boosting with second-order leaf values; deterministic."""
    p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Trees(math.log(p / (1 - p)), [], [], [])
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    edges = [np.unique(np.concatenate(([0.0], e))) for e in edges]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    wide = max(map(len, edges)) + 1
    f = np.full(len(y), model.base)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-f))
        g, h = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), dtype=np.int64)
        split, at = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.zeros(n)
            for j in range(x.shape[1]):
                cell = (node - first) * wide + binned[:, j]
                gs = np.bincount(cell, g, n * wide).reshape(n, wide).cumsum(axis=1)
                hs = np.bincount(cell, h, n * wide).reshape(n, wide).cumsum(axis=1)
                cs = np.bincount(cell, minlength=n * wide).reshape(n, wide).cumsum(axis=1)
                G, H, C = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + ridge) + (G - gs) ** 2 / (H - hs + ridge) - G**2 / (H + ridge)
                gain[(cs < least) | (C - cs < least)] = 0
                k = gain[:, : len(edges[j])].argmax(axis=1)
                top = gain[np.arange(n), k]
                better = top > best + 1e-9
                best[better] = top[better]
                split[first : first + n][better] = j
                at[first : first + n][better] = edges[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), split[node]] > at[node])
        leaf_of = node - len(split)
        leaf = rate * np.bincount(leaf_of, g, 2**depth) / (np.bincount(leaf_of, h, 2**depth) + ridge)
        f += leaf[leaf_of]
        model.split.append(split)
        model.at.append(at)
        model.leaf.append(leaf)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability), both rising."""
    order = np.argsort(margin, kind="stable")
    weight = np.ones(len(y)) if weight is None else weight
    blocks: list[list[float]] = []  # value sum, weight, margin sum
    for m, v, w in zip(margin[order], y[order], weight[order], strict=True):
        blocks.append([float(v * w), float(w), float(m * w)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, m2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2] + m2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a hundredth of the raw one keeps the order inside a calibrated step."""
        margin = self.trees.margin(x)
        raw = 1 / (1 + np.exp(-margin))
        if not len(self.knots[0]):
            return raw
        return 0.99 * np.interp(margin, *self.knots) + 0.01 * raw


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = 4000, clean_rows: int = 8000, forms_kept: int = 3000) -> Model:
    """Fit on about ``toxic_rows`` and ``clean_rows`` whole labelled texts, chosen by a hash of the id.

    The bounds hold whatever the number of labels.  Rows without a label, id or
    text take no part; of equal texts one is used; a row labelled twice is
    toxic if any label says so.  Without labels of both classes the score is
    the share of toxic labels, or one half.

    Everything is cross-fitted in ``FOLDS`` parts by a hash of the text: a
    row's features come from the lexicon without its part, and the margins that
    calibrate from trees without its part; the final trees learn from all.
    """
    spark = docs.sparkSession
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, toxic_rows / max(1, sizes.get(1, 0))).otherwise(clean_rows / max(1, sizes.get(0, 0)))
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    chosen = one.where(F.col("y").isin(0, 1) & (draw < share))
    # about toxic_rows + clean_rows ids of 12 bytes, whatever the input: small enough to send everywhere
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")
    sample = sample.groupBy(F.xxhash64("text").alias("text_key")).agg(F.max("y").alias("y"), F.max("text").alias("text"))
    sample = sample.withColumn("fold", F.pmod("text_key", F.lit(FOLDS)).cast("int")).persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("form", pa.binary()), ("pos", pa.int64()), ("neg", pa.int64())])
        for b in batches:
            seen = (Counter(), Counter())
            for y, t in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen[y].update({f for w in set(words_of(t)) for f in forms(w)})
            every = list({*seen[0], *seen[1]})
            yield out_batch(schema, form=every, pos=[seen[1][f] for f in every], neg=[seen[0][f] for f in every])

    by_fold = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = (sum(n for (_, y), n in by_fold.items() if y == c) for c in (1, 0))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    forms_df = in_arrow(sample.select("y", "text"), count, "form binary, pos bigint, neg bigint").groupBy("form").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    kept = forms_df.where((F.col("pos") >= 3) & (odds > 2.0)).orderBy(F.desc(odds * F.sqrt("pos")), "form").limit(forms_kept).collect()
    lexicon = Lexicon(n_pos, n_neg, {bytes(r["form"]): (r["pos"], r["neg"]) for r in kept})
    learned = spark.sparkContext.broadcast(frozenset(lexicon.counts))

    def count_learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("fold", pa.int32()), ("form", pa.binary()), ("pos", pa.int64()), ("neg", pa.int64())])
        for b in batches:
            seen: Counter = Counter()
            for fold, y, t in zip(b.column("fold").to_pylist(), b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen.update((fold, f, y) for f in learned.value.intersection(f for w in set(words_of(t)) for f in forms(w)))
            every = list({(fold, f) for fold, f, _ in seen})
            yield out_batch(schema, fold=[e[0] for e in every], form=[e[1] for e in every], pos=[seen[(*e, 1)] for e in every], neg=[seen[(*e, 0)] for e in every])

    in_fold: list[dict[bytes, tuple[int, int]]] = [{} for _ in range(FOLDS)]
    for r in in_arrow(sample.select("fold", "y", "text"), count_learned, "fold int, form binary, pos bigint, neg bigint").groupBy("fold", "form").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect():
        in_fold[r["fold"]][bytes(r["form"])] = (r["pos"], r["neg"])
    shared = spark.sparkContext.broadcast([lexicon.without(by_fold.get((k, 1), 0), by_fold.get((k, 0), 0), in_fold[k]) for k in range(FOLDS)])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("fold", pa.int32()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])
        for b in batches:
            folds = b.column("fold").to_pylist()
            yield out_batch(schema, key=b.column("text_key"), fold=folds, y=b.column("y"), x=[features(t, shared.value[k]) for t, k in zip(b.column("text").to_pylist(), folds, strict=True)])

    rows = sorted(in_arrow(sample.select("text_key", "fold", "y", "text"), own, "key bigint, fold int, y int, x array<double>").collect())
    sample.unpersist()
    x, y, fold = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], dtype=np.float64), np.array([r["fold"] for r in rows], dtype=np.int64)
    margin = np.zeros(len(y))
    for k in np.unique(fold):
        margin[fold == k] = fit_trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    # the sample holds the classes in other shares than the labels do; weights set that right in the calibration
    weight = np.where(y == 1, sizes.get(1, 0) / max(1, n_pos), sizes.get(0, 0) / max(1, n_neg))
    return Model(lexicon, fit_trees(x, y), isotonic(margin, y, weight))


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxic_score") -> DataFrame:
    """``df`` with a score from 0 to 1 for each whole text; every row stays, repeated ones too.

    A null or empty text is scored from features that are all 0.  An existing
    column named as the output is replaced.
    """
    df = df.drop(out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: forms_kept forms and the trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = np.array([features(t, m.lexicon) for t in b.column(text_col).to_pylist()]).reshape(-1, len(FEATURES))
            score = m.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, out_col])

    return in_arrow(df, run, schema)


def op4_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learned from the labelled rows not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = fit(docs.where(~held_out()), labels)
    out = score_toxicity(docs.select("doc_id", held_out().alias("held_out"), "text"), model, out_col="score")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
