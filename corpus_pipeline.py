"""The corpus pipeline: documents pass the stages in order.

Every stage works on all that the one before kept and returns the columns of
``documents``, but the last, which returns the encoded documents. Nulls: a null
text counts as empty, a null id is an id of its own. Rows that agree in id and
text are copies, of which the exact-dedup stage keeps one; the mix may repeat a
document, and then its rows repeat in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlake.llm import bagminhash, bpe, exact_dedup, mixing, toxicity
from sessionlake.llm.common import load, stored


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6; documents of score 0.5 or more go."""
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7; of equal documents one stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10; of every class of near copies one stays."""
    return bagminhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9; documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; doc_id, source, n_tokens, ids (packed unsigned 32-bit integers)."""
    return bpe.token_ids(docs, *bpe.vocabulary(), keep=("source",))


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]
#: Trained scores and signatures have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next reads it."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
