"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into substrings, each with a table of its own from the substring's value to codes: rows (part, value), which a join
finds by equality. Queries look up all values within a radius of their substrings, and the radius grows: after radius r in all of m tables, every
code within m * (r + 1) - 1 has been seen, as one of its substrings must be that near. A query leaves when its kth best verified
distance is within that bound, so the result is exact. Substrings are about as long as the logarithm of the number of codes,
so that a lookup meets few codes at any size.

Equal codes are one entry with their k + 1 smallest ids, and queries of equal codes are one query: a group of copies costs one
lookup. A code is counted where its nearest substring is found, in the first table that has it, so no pair is seen twice.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import broadcast_if_small, discard, materialize

WIDTH = 64
#: A round of more masks than this, and than there are codes, costs more than comparing all codes: the queries that are left meet every code.
MOST_MASKS = 200_000
#: Queries that meet every code at once.
SCAN_QUERIES = 10_000


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit b of the 64-bit code is set if component b is positive; components beyond 64 are folded in by position.

    Rows with a null id or vector have no code; null or NaN components count as not positive. Ids keep their type.
    """
    positive = lambda x: (x > 0) & ~F.isnan(x)
    bits = F.transform(F.col(vector_col), lambda x, b: F.when(positive(x), F.call_function("shiftleft", F.lit(1).cast("long"), (b % WIDTH).cast("int"))).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda code, bit: code.bitwiseXOR(bit))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), code.alias("code"))


def substring_bits(parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of each substring."""
    bits = [WIDTH // parts + (p < WIDTH % parts) for p in range(parts)]
    return [(sum(bits[:p]), bits[p]) for p in range(parts)]


def _part(code: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _substrings(code: Column, cuts: list[tuple[int, int]]) -> Column:
    """Columns part and value, a row for each substring."""
    return F.inline(F.array(*(F.struct(F.lit(p).alias("part"), _part(code, *cut).alias("value")) for p, cut in enumerate(cuts))))


def _masks(df: DataFrame, cuts: list[tuple[int, int]], low: int, high: int) -> DataFrame:
    """(part, mask) of all masks with ``low`` to ``high`` bits; as many as a substring has values at most."""
    rows = [(p, sum(1 << b for b in some)) for p, (_, bits) in enumerate(cuts) for r in range(low, min(high, bits) + 1) for some in combinations(range(bits), r)]
    return df.sparkSession.createDataFrame(rows, "part int, mask long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; row_number with a bound leaves k of them in every task."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "distance", "id")


def _all_compared(active: DataFrame, codes: DataFrame) -> DataFrame:
    """(query, distance, id) of all codes within the worst distance of a query, for blocks of queries of a bounded size."""
    blocks = -(-active.count() // SCAN_QUERIES)
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    parts = [codes.join(F.broadcast(active.where(block == b)), distance <= F.col("worst")) for b in range(blocks)]
    return reduce(DataFrame.union, parts).select("query", distance.alias("distance"), F.explode("ids").alias("id"))


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = 10, parts: int | None = None, first_radius: int | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest codes of each query by Hamming distance, ties by id.

    ``codes`` and ``queries`` are (id, code). A row is no neighbour of its own id; equal codes of other ids are, at distance 0. Of
    repeated ids one row counts, that with the least code. Null ids and codes are passed over. A query with fewer than k others gets fewer
    rows. ``parts`` and the radius to begin with, at which as many codes are to be expected as are wanted, follow from the number of codes unless
    they are given. No queries or codes
    give no rows.
    """
    codes = materialize(codes.where("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code")), "codes")
    queries = materialize(queries.where("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code")), "queries")
    total = codes.count()
    parts = parts or max(2, math.ceil(WIDTH / math.log2(total + 16)))
    cuts = substring_bits(parts)
    # a code's first ids: row_number with a bound keeps k + 1 rows of each code in every task
    order = Window.partitionBy("code").orderBy("id")
    few = codes.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    groups = few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    index = materialize(groups.select("code", "ids", _substrings(F.col("code"), cuts)), "index")
    active = materialize(queries.select(F.col("code").alias("query"), F.lit(WIDTH).alias("worst")).distinct(), "active")

    wanted = min(k + 1, total)
    radius = first_radius
    if radius is None:
        met = 0.0
        for radius in range(max(bits for _, bits in cuts) + 1):
            met += sum(math.comb(bits, radius) * total / 2**bits for _, bits in cuts)
            if met >= wanted:
                break
    best, low = None, 0
    lookup = broadcast_if_small(index)
    while total and not active.isEmpty():
        if sum(math.comb(bits, r) for _, bits in cuts for r in range(low, radius + 1)) > max(MOST_MASKS, total):
            kept = materialize(_first(_all_compared(active, index.where("part = 0")), k + 1), "best")
            best = kept if best is None else materialize(best.join(active, "query", "left_anti").union(kept), "best")
            break
        values = active.select("query", "worst", _substrings(F.col("query"), cuts))
        probes = values.join(F.broadcast(_masks(active, cuts, low, radius)), "part")
        probes = probes.select("query", "worst", "part", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        hits = probes.join(lookup, ["part", "value"])
        differ = F.col("query").bitwiseXOR(F.col("code"))
        near = [F.bit_count(_part(differ, *cut)) for cut in cuts]
        # the first of the nearest substrings finds the code
        nearest = F.least(*near)
        first = reduce(lambda rest, p: F.when(near[p] == nearest, p).otherwise(rest), reversed(range(parts)), F.lit(parts))
        distance = F.bit_count(differ)
        found = hits.where((F.col("part") == first) & (distance <= F.col("worst"))).select("query", distance.alias("distance"), F.explode("ids").alias("id"))
        if best is not None:
            found = found.union(best)
        kept = materialize(_first(found, k + 1), "best")
        discard(best)
        best = kept
        covered = parts * (radius + 1) - 1
        state = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        settled = (F.col("n") >= wanted) & ((F.col("last") <= covered) | F.lit(total <= k + 1))
        done = state.select("query", F.when(F.col("n") >= wanted, F.col("last")).otherwise(WIDTH).alias("worst"), settled.alias("settled"))
        left = active.select("query").join(done, "query", "left").where("not coalesce(settled, false)")
        after = materialize(left.select("query", F.coalesce("worst", F.lit(WIDTH)).alias("worst")), "active")
        discard(active)
        active, low, radius = after, radius + 1, radius + 1
    if best is None:
        best = index.select(F.col("code").alias("query"), F.lit(0).alias("distance"), F.explode("ids").alias("id")).limit(0)
    # at most k + 1 entries for each code
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    asked = queries.join(broadcast_if_small(materialize(lists, "lists")), F.col("code") == F.col("query"))
    ranked = asked.select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("rank", "x"))
    return ranked.select(F.col("id").alias("query_id"), (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").cast("long").alias("distance"))

