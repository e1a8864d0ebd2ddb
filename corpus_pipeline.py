"""From raw documents to packed training windows: quality, exact copies, near copies, source weights, packing.

All stages take rows with nulls, empty and very long texts, repeated rows and ids, further columns under any name, and empty tables;
what becomes of them is stated at the stages and their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact, mixing, omh, packing, quality
from quarry.llm.queries import table, tokenizer_path
from quarry.llm.text import word_count
from quarry.runtime import materialize

#: The stages' decisions come from a learnt model and sampled hashes, which SQL cannot express.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the threshold; a null text is scored as an empty one."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set that is identical but for white space: the longest, then the one with the smallest id."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return omh.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them; a source's last one is cut to the budget's last word.

    Documents without words take no part. Further columns, also those named like the mix's own ones, come out as they came in.
    """
    # the columns' own names are set aside meanwhile
    place = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    plain = docs.toDF(*place.values())
    text = place["text"]
    mixed = mixing.mix_sources(plain, word_count(F.col(text)), place["doc_id"], place["source"])
    mixed = mixing.repeat_taken(mixed, text)
    if chars := place.get("n_chars"):
        mixed = mixed.withColumn(chars, F.when(F.col("cut"), F.length(text)).otherwise(F.col(chars)).cast(docs.schema["n_chars"].dataType))
    return mixed.select(*place.values()).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 token ids; a null text is packed as an empty one."""
    return packing.pack_windows(docs, tokenizer_path())


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written as Parquet to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
