"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.text import names_apart
from quarry.operators.prefix import range_partitioned, sums_of_ranges
from quarry.runtime import broadcast_if_small, materialize


def source_targets(sized: DataFrame, source: str, size: str, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target): the sources' shares of the total of all sizes.

    Sources in code-point order, null last, take ``weights`` in turn. A target stops at ``max_epochs`` times its source's
    size; the excess is shared anew by weight until no target is above. In ascending order of cap / weight the level
    (rest of the total) / (rest of the weights) rises while sources are capped and falls afterwards, so the final level is its
    maximum: no iteration is needed. The windows below hold a row for each source.
    """
    totals = materialize(sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size")), "sources")
    ranked = totals.withColumn("__k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.array(*(F.lit(float(w)) for w in weights))
    weighed = ranked.withColumns({"__w": F.get(turn, (F.col("__k") % len(weights)).cast("int")), "__cap": F.col("source_size") * max_epochs})
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "__k").rowsBetween(Window.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(everything), F.sum("__w").over(everything)
    left = (total - F.coalesce(F.sum("__cap").over(before), F.lit(0))).cast("double")
    level = left / (heavy - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("__level", level).withColumn("__level", F.max("__level").over(everything))
    target = F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__w"))
    return leveled.select("source", "source_size", target.alias("target"))


@names_apart
def mix_sources(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target and taken: the words that the mix takes from each row.

    Rows get a hash-random key from their id; within each source they are range-sorted by it and prefix sums of sizes are
    formed from partition totals. A source's budget is its target in whole words; whole epochs come first, then rows in key
    order until the budget is used up exactly, so that one row of a source may be taken in part.

    A row of size 0 or null is kept with taken 0; a null source is a source of its own, the last. Rows with equal ids are
    ordered by size, then content; equal rows are interchangeable. Input columns named like the added ones are replaced.
    No rows give no rows. Reruns take the same words from the same rows.
    """
    sized = docs.withColumn("size", F.coalesce(size.cast("long"), F.lit(0)).cast("long"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = sized.withColumn("__key", key)
    order = [F.col("__key"), F.col("size")]
    ranged = range_partitioned(sized.drop("source_size", "target", "taken"), order, [source_col])
    summed = sums_of_ranges(ranged, "size", order, [source_col])
    targets = source_targets(ranged, source_col, "size", weights, max_epochs).withColumnRenamed("source", "__source")
    mixed = summed.join(broadcast_if_small(targets), F.col(source_col).eqNullSafe(F.col("__source")))
    total = F.col("source_size")
    budget = F.least(total * max_epochs, F.round("target").cast("long"))
    epochs = F.when(total > 0, F.floor(budget / F.greatest(total, F.lit(1)))).otherwise(0).cast("long")
    rest = budget - F.col("__epochs") * total
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("__before")))
    taken = (F.col("size") * F.col("__epochs") + part).cast("long")
    return mixed.withColumn("__epochs", epochs).withColumn("taken", taken).drop("__key", "__before", "__index", "__source", "__epochs")


def repeat_taken(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: each row as often as it is taken in full, and for a part of it the text's first words.

    Rows of which nothing is taken go. Only a source's last row is cut, after its words within the budget; such a row has a
    true ``cut``.
    """
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    words = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.when(whole > 0, F.array_repeat(F.lit(False), whole)).otherwise(F.array().cast("array<boolean>"))
    copies = F.concat(copies, F.when(words > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), 0), 1, F.greatest(words, F.lit(1))), "")
    out = mixed.where("taken > 0").withColumn("cut", F.explode(copies))
    return out.withColumn(text_col, F.when(F.col("cut"), first).otherwise(F.col(text_col)))
