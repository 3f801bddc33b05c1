"""The training-data pipeline: five stages, each working on all that the one before kept.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows, an
empty table and further columns, as the operators that it calls state; further columns are
kept by all but the last.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vintagepanel.llm import byte_bpe, exact_dedup, jaccard_join, mixing, toxicity
from vintagepanel.llm.common import scratch_table, table
from vintagepanel.llm.queries import MAX_REPEATS, RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their word 5-grams, that with the smallest doc_id stays."""
    return jaccard_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of smaller sources again, within the repetition limit."""
    return mixing.mixed_documents(docs, MAX_REPEATS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return byte_bpe.op3(spark, docs, public_tokenizers.path(RANKS))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: A support vector machine and MinHash links have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
