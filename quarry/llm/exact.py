"""Exact de-duplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import names_apart, without_space
from quarry.runtime import broadcast_if_small, materialize

#: Characters of the normalised text that the second step hashes.
PREFIX = 256


def _tagged(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the normalised text, its length and its prefix hash."""
    normal = docs.withColumn("__norm", without_space(F.col(text_col)))
    return normal.withColumns({"__len": F.length("__norm"), "__head": F.xxhash64(F.substring("__norm", 1, PREFIX))})


def surviving_groups(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(__len, __head) of the groups of two or more rows that equal length and prefix leave; nothing else can hold copies.

    The first count is by length alone; prefixes are counted only where a length repeats.
    """
    slim = materialize(_tagged(docs, text_col).select("__len", "__head"), "lengths")
    repeated = slim.groupBy("__len").agg(F.count("*").alias("__n")).where("__n > 1").select("__len")
    heads = slim.join(broadcast_if_small(repeated), "__len", "left_semi").groupBy("__len", "__head").agg(F.count("*").alias("__n"))
    return materialize(heads.where("__n > 1").select("__len", "__head"), "heads")


def _hashed(docs: DataFrame, text_col: str, every: bool) -> DataFrame:
    """``docs`` with ``__full``, the SHA-256 of the normalised text: of surviving groups only, or of every row."""
    groups = surviving_groups(docs, text_col).withColumn("__shared", F.lit(True))
    marked = _tagged(docs, text_col).join(broadcast_if_small(groups), ["__len", "__head"], "left")
    full = F.sha2(F.col("__norm"), 256)
    return marked.withColumn("__full", full if every else F.when(F.col("__shared"), full)).drop("__norm", "__len", "__head")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_hash: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after white space is deleted; null counts as empty. Of equal texts the row with the
    most code points stays, then the one with the smallest id (a null id last). Of rows that agree in both, one stays.
    text_sha256 is null for rows whose length and prefix no other row has, unless ``every_hash`` asks for it. Columns other
    than the two named ones are ignored. No rows give no rows.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    full = _hashed(chosen, "__text", every_hash)
    slim = full.select("doc_id", F.coalesce(F.length("__text"), F.lit(0)).alias("__chars"), "__shared", F.col("__full").alias("text_sha256"))
    rows = materialize(slim.withColumn("__row", F.monotonically_increasing_id()), "hashes")
    order = F.struct((-F.col("__chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("__row").alias("r"))
    shared = rows.where("__shared")
    groups = materialize(shared.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("__best")), "groups")
    found = shared.join(broadcast_if_small(groups), "text_sha256").select(
        "doc_id", F.col("__best.i").alias("keep_id"), "group_size", (F.col("__best.r") == F.col("__row")).alias("kept"), "text_sha256"
    )
    alone = rows.where("__shared is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    out = found.union(alone)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


@names_apart
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the rule is that of :func:`exact_groups`.

    Rows without a possible copy pass without a shuffle; of the others, the best row of each text is found by a partial maximum,
    so that copies meet only after each task has kept one.
    """
    full = _hashed(docs, text_col, every=False)
    order = F.struct((-F.coalesce(F.length(text_col), F.lit(0))).alias("c"), F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    best = full.where("__shared").groupBy("__full").agg(F.min_by(row, order).alias("__best")).select("__best.*")
    return full.where("__shared is null").select(*(f"`{c}`" for c in docs.columns)).union(best)
