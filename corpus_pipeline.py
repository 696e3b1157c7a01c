"""Cleaning pipeline over `documents`: toxic texts, exact copies, near copies and texts with benchmark passages go; the rest is encoded.

Every stage but the last returns the columns of `documents`; each works on all rows that the one before kept.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from vertexloom.llm import decontaminate, exact_dedup, near_dedup, pieces, toxicity
from vertexloom.llm.queries import table, tokenizer
from vertexloom.plans.lineage import cut


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows that aren't held out, and drops every text that scores THRESHOLD or more. Null and empty texts score as texts without
    matches; repeated rows score alike; no rows give none."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.is_held_out())
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest id stays (of rows with one id too, one stays). Null counts as empty."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on runs of five words (the rule for pipelines; op3's contract names two), the document with the smallest
    id stays. Texts without words, null ones too, are linked with nothing and stay."""
    return near_dedup.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts go that have ten consecutive words of a benchmark item, or all of a shorter one. Null texts have no words and stay; repeated rows go or stay together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text with merge-dropout, and whether they decode to it. A null text has null pieces and 0 tokens; each row gives one row."""
    coded = pieces.with_pieces(docs, tokenizer("piece_bpe_32k.model"), ["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.coalesce(F.array_size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"), "ids", "lossless")


STAGES = [("toxicity", toxic), ("exact dedup", copies), ("near dedup", near_copies), ("decontamination", benchmark_passages), ("encoding", encode)]

#: A learned model and seeded pieces can't be stated in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
