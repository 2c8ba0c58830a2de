"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.  Columns beyond
those of ``documents`` stay, whatever they are called, but where a stage says
otherwise.  An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm import decontaminate, langid, neardup, packing, pii
from goldweave.llm.common import materialise, table

#: A document is rejected where the best language knows less of its n-grams, as a part of what it knows of its own texts.
#: On check_s the least clean text has 0.58; texts of hexadecimal words have 0.43 on average, of numbers 0.37, base64 0.11.
LEAST_RECOGNISED = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a recognised language go.

    A null text and one without a letter have none.  Learned from the rows that
    have a text and a language; repeated rows are decided alike, and with no
    language to learn from everything goes.  Columns named ``_lang``, ``_score``
    and ``_share`` are dropped.
    """
    model = langid.fit_filters(docs)
    out = langid.identify(docs, model, lang_out="_lang", score_out="_score", share_out="_share")
    return out.where((F.col("_lang") != "und") & (F.col("_share") >= LEAST_RECOGNISED)).drop("_lang", "_score", "_share")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays.

    It is the one of the least id, and of equal ids the one whose text has the
    least hash; of repeated rows one stays.  Rows without an id all stay; a null
    text is a group of its own for each id.
    """
    return neardup.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a benchmark item go.

    Null texts, texts without words and rows without an id stay or go by their
    text alone; repeated rows are decided alike; an empty benchmark rejects nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span is replaced by its kind, and ``n_chars`` follows.

    Spans that overlap are one, named by the kind of the first; null texts stay
    null, with a null ``n_chars``; no row is lost or added, repeated ones
    included.
    """
    return pii.mask_personal_data(docs).withColumn("n_chars", F.length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents in sequences of 1024 tokens.

    A null text is its end token; repeated rows and rows without an id are
    packed like any other; equal projections are ordered by id.  Only the id and
    the text are read.
    """
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark_passages), ("personal_data", personal_data), ("packing", sequences)]

#: Signatures, searches, bootstrapping and packing are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
