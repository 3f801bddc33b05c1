"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vintagepanel.llm import ann_tree, byte_bpe, exact_dedup, fingerprints, html_text, jaccard_join, lexical_search, line_dedup, mixing, ring_sharding, toxicity, vector_codes, warc
from vintagepanel.llm.common import table

#: Shards of op9_ring_sharding.
SHARDS = 24


#: Repetition limit of op6_mixing and of the pipeline.
MAX_REPEATS = 2.0
#: Rank file of op3_byte_bpe.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op1(spark, table(spark, sf_dir, "pages"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op2(spark, table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.op3(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op4_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.op4(spark, table(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6(spark, table(spark, sf_dir, "documents"), MAX_REPEATS)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op8(spark, table(spark, sf_dir, "documents"))


def op9_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op10(spark, table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op12(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.op13(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_html_text, op3_byte_bpe, op4_ann_tree, op5_exact_dedup, op6_mixing, op7_toxicity, op8_line_dedup, op9_ring_sharding, op10_jaccard_join, op11_lexical_search, op12_order_minhash, op13_vector_codes)
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
