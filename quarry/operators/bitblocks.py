"""Bits packed in blocks, and one pass over them for all that block statistics can tell.

Bits (seq_id, idx, bit) become words of 64 by a partial aggregate that needs no order, and blocks of words. Each block is read with the
first bits of the next one, so whatever begins in a block is complete, and runs or words that cross its end are counted once, where they begin.
A block's facts are numbers under a name and two keys, and facts of several blocks are added up: counts, sums of squares, histograms of
classes. What depends on earlier blocks is kept apart by block: sums and extremes of the walk, and the first and last place of each word, which
a window over blocks, thousands of times fewer than bits, puts together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import broadcast_if_small, materialize

WORD = 64
#: Bits of a block; no test's own block is longer.
BLOCK = 65_536
#: Words of the next block that a block is read with.
HEAD = 160
Fact = tuple[str, int, int, int]


def unpacked(words: Sequence[int], n: int) -> np.ndarray:
    """The first ``n`` bits of words, the highest bit first."""
    return np.unpackbits(np.asarray(words, dtype=">i8").view(np.uint8))[:n]


class Piece:
    """A block's bits in Python: ``own`` are its bits, ``ahead`` those with what follows in the sequence, ``round`` those and, at the end, the first ones again."""

    def __init__(self, start: int, n: int, words, more: int, following, first: int, beginning, total: int):
        self.start, self.n, self.total = start, n, total
        self.own = unpacked(words, n)
        self.ahead = np.concatenate((self.own, unpacked(following, more))) if more else self.own
        self.round = self.ahead
        if start + len(self.ahead) == total:
            begin = unpacked(beginning, first)
            self.round = np.concatenate((self.ahead, np.tile(begin, -(-WORD // max(1, first)))[:WORD]))

    def parts(self, m: int) -> np.ndarray:
        """The complete test blocks of ``m`` bits that begin here, one a row."""
        begin = -self.start % m
        count = max(0, min(-(-(self.n - begin) // m), (self.total - self.start - begin) // m))
        return self.ahead[begin : begin + count * m].reshape(count, m)

    def words(self, width: int, cyclic: bool) -> np.ndarray:
        """The word of ``width`` bits from each place of this block on, as far as they are complete."""
        bits = self.round if cyclic else self.ahead
        count = min(self.n, len(bits) - width + 1)
        out = np.zeros(max(0, count), np.int64)
        for k in range(width):
            out = out << 1 | bits[k : k + len(out)]
        return out


Measure = Callable[[Piece], Iterator[Fact]]


class BitBlocks:
    """The packed bits of a table of sequences; facts that were gathered once are kept."""

    def __init__(self, bits: DataFrame, size: int = BLOCK):
        self.size, self.kind = size, bits.schema["seq_id"].dataType.simpleString()
        shift = (WORD - 1 - F.col("idx") % WORD).cast("int")
        words = bits.groupBy("seq_id", F.floor(F.col("idx") / WORD).cast("long").alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.col("bit").cast("long"), shift)).alias("v"), F.count("*").alias("c")
        )
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"])
        blocks = words.groupBy("seq_id", F.floor(F.col("w") / (size // WORD)).cast("long").alias("block")).agg(ordered.alias("words"), F.sum("c").alias("n"))
        self.blocks = materialize(blocks, "bits")
        self.sizes = materialize(self.blocks.groupBy("seq_id").agg(F.sum("n").alias("n"), F.min_by(F.struct(F.get("words", 0).alias("v"), "n"), "block").alias("first")), "sizes")
        self._facts: dict[str, DataFrame] = {}

    def lengths(self) -> DataFrame:
        """(seq_id, n)."""
        return self.sizes.select("seq_id", "n")

    def read(self, offsets: DataFrame | None = None) -> DataFrame:
        """Blocks with what a :class:`Piece` needs, and a column ``before`` from ``offsets`` (seq_id, block, before)."""
        heads = self.blocks.select("seq_id", (F.col("block") - 1).alias("block"), F.slice("words", 1, HEAD).alias("following"), F.least("n", F.lit(HEAD * WORD)).alias("more"))
        of = broadcast_if_small(self.sizes.select("seq_id", F.col("n").alias("total"), F.array("first.v").alias("beginning"), F.least("first.n", F.lit(WORD)).alias("first")))
        wide = self.blocks.join(broadcast_if_small(heads, 10_000), ["seq_id", "block"], "left").join(of, "seq_id")
        if offsets is not None:
            wide = wide.join(broadcast_if_small(offsets), ["seq_id", "block"])
        wide = wide.withColumn("before", F.lit(0).cast("long")) if offsets is None else wide
        return wide.select("seq_id", "block", "n", "words", F.coalesce("more", F.lit(0)).alias("more"), "following", "first", "beginning", "total", "before")

    def _measured(self, measures: dict[str, Callable[..., Iterator[Fact]]], offsets: DataFrame | None = None) -> DataFrame:
        """(seq_id, measure, fact, a, b, value), added up over blocks."""
        size, placed = self.size, offsets is not None

        def run(frames: Iterator) -> Iterator:
            import pandas as pd

            for frame in frames:
                found = []
                columns = (frame[c] for c in ("seq_id", "block", "n", "words", "more", "following", "first", "beginning", "total", "before"))
                for seq, block, n, words, more, following, first, beginning, total, before in zip(*columns, strict=True):
                    piece = Piece(int(block) * size, int(n), words, int(more), following, int(first), beginning, int(total))
                    for name, measure in measures.items():
                        found += [(seq, name, *fact) for fact in (measure(piece, int(before)) if placed else measure(piece))]
                yield pd.DataFrame(found, columns=["seq_id", "measure", "fact", "a", "b", "value"])

        rows = self.read(offsets).mapInPandas(run, f"seq_id {self.kind}, measure string, fact string, a long, b long, value long")
        return materialize(rows.groupBy("seq_id", "measure", "fact", "a", "b").agg(F.sum("value").alias("value")), "facts")

    def gather(self, measures: dict[str, Measure]) -> None:
        """Take several measures in one pass."""
        if new := {k: v for k, v in measures.items() if k not in self._facts}:
            found = self._measured(new)
            self._facts |= {k: found.where(F.col("measure") == k).drop("measure") for k in new}

    def facts(self, name: str, measure: Measure) -> DataFrame:
        """(seq_id, fact, a, b, value) of a measure, from an earlier pass if that gathered it."""
        self.gather({name: measure})
        return self._facts[name]

    def offsets(self) -> DataFrame:
        """(seq_id, block, before, total, low, high): the walk's sum before each block, and its sum and extremes within it."""
        steps = self.facts("walk", walk_facts)
        each = steps.groupBy("seq_id", F.floor(F.col("a") / self.size).cast("long").alias("block")).agg(*(F.max(F.when(F.col("fact") == c, F.col("value"))).alias(c) for c in ("total", "low", "high")))
        before = Window.partitionBy("seq_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return each.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0)))

    def walked(self) -> DataFrame:
        """(seq_id, fact, a, b, value) of a second pass, in which each block knows where the walk stands."""
        if "visits" not in self._facts:
            offsets = materialize(self.offsets().select("seq_id", "block", "before"), "offsets")
            self._facts["visits"] = self._measured({"visits": visit_facts}, offsets).drop("measure")
        return self._facts["visits"]

    def bits(self) -> DataFrame:
        """(seq_id, idx, bit, n) again."""
        words = self.blocks.join(broadcast_if_small(self.lengths().withColumnRenamed("n", "total")), "seq_id")
        words = words.select("seq_id", "total", "block", F.posexplode("words").alias("w", "v"))
        each = words.select("seq_id", "total", (F.col("block") * self.size + F.col("w") * WORD).alias("start"), "v", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("k"))
        bit = F.call_function("shiftrightunsigned", F.col("v"), WORD - 1 - F.col("k")).bitwiseAND(F.lit(1).cast("long")).cast("tinyint")
        return each.select("seq_id", (F.col("start") + F.col("k")).alias("idx"), bit.alias("bit"), F.col("total").alias("n")).where("idx < n")


def packed(bits: DataFrame | BitBlocks) -> BitBlocks:
    return bits if isinstance(bits, BitBlocks) else BitBlocks(bits)


def columns_of(facts: DataFrame, wanted: dict[str, Column], by: Sequence[str] = ("seq_id",)) -> DataFrame:
    """A row for each ``by``, with the value of the fact that each condition names; 0 where there is none."""
    return facts.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(condition, F.col("value"))), F.lit(0)).alias(name) for name, condition in wanted.items()))


def _tally(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(a, b, count) of each pair; b is from 0 to 2^32."""
    pairs, counts = np.unique((a.astype(np.int64) << 32) + b, return_counts=True)
    return zip((pairs >> 32).tolist(), (pairs & (2**32 - 1)).tolist(), counts.tolist(), strict=True)


# ---- measures ------------------------------------------------------------------------------------------------------------


def count_facts(p: Piece) -> Iterator[Fact]:
    """Ones, and places where the next bit differs."""
    yield "ones", 0, 0, int(p.own.sum())
    pairs = p.ahead[: p.n + 1]
    yield "changes", 0, 0, int((pairs[1:] != pairs[:-1]).sum())


def share_facts(m: int) -> Measure:
    """Complete blocks of m bits, and the sum of (2 ones - m)^2."""

    def measure(p: Piece) -> Iterator[Fact]:
        ones = p.parts(m).sum(axis=1, dtype=np.int64)
        yield "blocks", m, 0, len(ones)
        yield "squares", m, 0, int(np.square(2 * ones - m).sum())

    return measure


def longest_ones(parts: np.ndarray) -> np.ndarray:
    """The longest run of ones of each row."""
    so_far = np.cumsum(parts, axis=1, dtype=np.int32)
    return (so_far - np.maximum.accumulate(np.where(parts == 0, so_far, 0), axis=1)).max(axis=1) if parts.size else np.zeros(0, np.int32)


def class_facts(choose: Callable[[int], int], classes: Callable[[np.ndarray, int], np.ndarray]) -> Measure:
    """How many of the blocks of m bits, m by the sequence's length, are in each class: (class, m)."""

    def measure(p: Piece) -> Iterator[Fact]:
        m = choose(p.total)
        kinds, counts = np.unique(classes(p.parts(m), m), return_counts=True)
        yield from (("class", k, m, c) for k, c in zip(kinds.tolist(), counts.tolist(), strict=True))

    return measure


def ones_in_a_row(parts: np.ndarray, size: int) -> np.ndarray:
    """How often each row has ``size`` ones in a row, overlapping ones too."""
    so_far = np.cumsum(parts, axis=1, dtype=np.int32)
    before = np.concatenate((np.zeros((len(parts), 1), np.int32), so_far[:, :-size]), axis=1)
    return (so_far[:, size - 1 :] - before == size).sum(axis=1)


def gram_facts(width: int) -> Measure:
    """Cyclic words of ``width`` bits."""

    def measure(p: Piece) -> Iterator[Fact]:
        words, counts = np.unique(p.words(width, True), return_counts=True)
        yield from (("gram", int(w), width, int(c)) for w, c in zip(words, counts, strict=True))

    return measure


def template_facts(chosen: Sequence[int], size: int, blocks: int, length: int | None) -> Measure:
    """Places of each template by the large block that holds it whole."""

    def measure(p: Piece) -> Iterator[Fact]:
        m = max(1, (p.total if length is None else length) // blocks)
        words = p.words(size, False)
        place = p.start + np.arange(len(words))
        good = np.isin(words, chosen) & (place % m <= m - size) & (place < m * blocks)
        yield from (("hits", *pair) for pair in _tally(words[good], place[good] // m))

    return measure


def distance_facts(choose: Callable[[int], int], first: int | None) -> Measure:
    """Distances of non-overlapping words to their last occurrence within a block, and each word's first and last place in it."""

    def measure(p: Piece) -> Iterator[Fact]:
        width = choose(p.total)
        initial = 10 * 2**width if first is None else first
        parts = p.parts(width)
        if not len(parts):
            return
        words = parts @ (1 << np.arange(width - 1, -1, -1))
        place = (p.start + (-p.start % width)) // width + 1 + np.arange(len(words))
        order = np.argsort(words, kind="stable")
        ranked, at = words[order], place[order]
        fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        later = np.flatnonzero(~fresh)
        later = later[at[later] > initial]
        gaps, counts = np.unique(at[later] - at[later - 1], return_counts=True)
        yield from (("gap", int(g), width, int(c)) for g, c in zip(gaps, counts, strict=True))
        firsts = np.flatnonzero(fresh)
        lasts = np.append(firsts[1:], len(ranked)) - 1
        # the last place goes with the word and the first one, which no other block has
        yield from (("ends", int(w) + (width << 32), int(f), int(last)) for w, f, last in zip(ranked[firsts], at[firsts], at[lasts], strict=True))

    return measure


def walk_facts(p: Piece) -> Iterator[Fact]:
    """Sum and extremes of the walk in each block."""
    s = np.cumsum(2 * p.own.astype(np.int64) - 1)
    yield from ((name, p.start, 0, int(x)) for name, x in (("total", s[-1]), ("low", s.min()), ("high", s.max())))


NEAR, FAR = 4, 9


def visit_facts(p: Piece, before: int) -> Iterator[Fact]:
    """Visits to near states, zeros, and visits by cycle: of whole cycles as a histogram, of those that cross an end of the block by state and end."""
    s = before + np.cumsum(2 * p.own.astype(np.int64) - 1)
    states, counts = np.unique(s[(np.abs(s) <= FAR) & (s != 0)], return_counts=True)
    yield from (("visits", int(x), 0, int(c)) for x, c in zip(states, counts, strict=True))
    zeros = np.flatnonzero(s == 0)
    yield "zeros", p.start, 0, len(zeros)
    near = np.flatnonzero((np.abs(s) <= NEAR) & (s != 0))
    cycle = np.searchsorted(zeros, near)
    inner = []
    for state, at, count in _tally(s[near], cycle):
        if 0 < at < len(zeros):
            inner.append((state, min(count, 5)))
        else:
            yield "tail" if at else "head", state, p.start, count
    kinds = np.array(inner, np.int64).reshape(-1, 2)
    yield from (("cycles", *kind) for kind in _tally(kinds[:, 0], kinds[:, 1]))
