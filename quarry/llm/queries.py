"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import binpack, clusters, dialogue, exact, hamming, language, mixing, omh, packing, quality, secrets, sharding, urls
from quarry.llm.oracles import ORACLES as ORACLES
from quarry.llm.text import word_count
from quarry.runtime import materialize


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public tokenizer's file; this one has the vocabulary and ids of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of the URL contract.
URL_RULES = (
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_windows(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written, so that the search for ranges does not count the words of all texts once more
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    return mixing.mix_sources(docs, F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def op5_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_matrix(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", sharding.byte_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    )
    placed = sharding.shard_by_bytes(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), every_hash=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming.hamming_top_k(codes, codes.where("id % 20 = 0"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    report, repaired = dialogue.repair_conversations(dialogue.damage(conversations))
    return dialogue.full_report(conversations, report, dialogue.repaired_digests(repaired))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = language.learn(docs.where(~language.is_held_out(F.col("doc_id"))))
    found = language.identify_language(docs, samples)
    return found.select("doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pack, op2_urls, op3_near_dups, op4_mix, op5_binary, op6_quality, op7_shards, op8_exact, op9_top_k, op10_secrets, op11_repair, op12_language, op13_clusters)
}
