"""A corpus made ready for training: quality, line dedup, near dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns
they came with and their values, whatever their names; the last returns the packed pieces.
Columns ``doc_id`` and ``text`` are needed; ``n_chars``, where there is one, is counted anew. An
empty table stays empty in every stage, and very long texts count whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm.linededup import dedup_lines
from tracklore.llm.minhash import near_duplicates
from tracklore.llm.packing import pack
from tracklore.llm.quality import fit, score
from tracklore.llm.runtime import cut, release, unused
from tracklore.llm.secrets import find_secrets, redact

#: Documents with a lower chance of good quality go.
LEAST_QUALITY = 0.5
#: What a text must hold to be more than blanks and rules.
WORD = r"[\p{L}\p{N}]"


def _beside(docs: DataFrame, results: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs``, whose columns come back with their values, also those named like ``results``."""
    clashing = [c for c in docs.columns if c.lower() in results]
    aside = dict(zip(clashing, unused(docs, *(f"{c}_of_docs" for c in clashing)), strict=True))
    changed = work(docs.withColumnsRenamed(aside))
    return changed.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores as good quality, by a classifier fitted to the table ``labels``.

    A null or empty text has the score of no evidence; equal texts have equal scores, so repeated
    rows stay or go together; rows with a null id are scored like all others.
    """
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _beside(docs, ["quality_score"], lambda d: score(d, weights).where(F.col("quality_score") >= LEAST_QUALITY))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur elsewhere first; those that lose all their words that way go.

    Null and empty texts, texts that never had a word and documents with a null id are unchanged;
    rows that repeat an id and text are one document, and stay with the same lines or go together.
    """

    def work(d: DataFrame) -> DataFrame:
        left = dedup_lines(d, short_lines=True)
        return left.where((F.col("n_lines_removed") == 0) | F.col("text").rlike(WORD))

    return _counted(_beside(docs, ["n_lines", "n_lines_removed"], work))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id.

    Null and empty texts and documents with a null id have no duplicates and stay; rows that
    share an id are one document and stay or go together.
    """
    others = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; a null text stays null, and repeated rows change alike."""
    return _counted(_beside(docs, ["secrets"], lambda d: redact(find_secrets(d))))


def to_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    A null or empty text is its end token; repeated rows are packed each; other columns go.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("near_duplicates", keep_one),
    ("secrets", hide_secrets),
    ("packing", to_sequences),
]

#: The classifier, edit distances over words and tokens have no SQL equivalent; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs)
            release(spark)
    return docs
