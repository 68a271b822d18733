"""The corpus pipeline: from ``documents`` to the token ids of a training mix.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; the one before is
written as Parquet and read again as its docs. All stages but the last return the
columns of documents, whatever these are named; an empty table stays empty in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motionlake.llm import bpe, exact_dedup, minhash, mixing, toxicity
from motionlake.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual-regularised classifier calls toxic go.

    Null and empty texts are scored like any text. Rows with a null id stay or go by
    their text but teach nothing; repeated rows are judged alike.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal chunk recipes, the longest stays, then the one of the smallest id.

    Null and empty texts are equal; a null id comes after all others; of rows that are
    repeated as a whole one stays.
    """
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the smallest id.

    Texts without words and rows with a null id are linked with nothing and stay; ties of
    one id go to the text of the least md5; rows repeated as a whole stay or go together.
    """
    return minhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target words.

    Null sources are one source; rows without words stay once; rows of one id, or of none,
    are rounded each on its own.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix: doc_id, source, ids.

    A null or empty text has no ids; each repetition of a row is encoded.
    """
    return bpe.bpe_encode(docs, bpe.default_vocabulary(), keep=["source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier, the confirmed links' components and the merges aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
