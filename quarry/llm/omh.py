"""Near-duplicate classes by Order MinHash with banded alignment.

A document's words give k-mers of ``k`` words, each labelled with its occurrence number, so that repeats count. For each of
``bands`` hash functions the ``picks`` smallest labelled k-mers are taken and put back into text order; their hash is a bucket
key, which documents share more often the smaller their edit distance is, not merely their set of k-mers. Candidates are
verified by a banded alignment of their words.

Equal texts are one node. First the two outermost nodes of each bucket are compared, which settles buckets of two; then the nodes of larger
buckets with few leaders, other ones in each bucket and turn. Classes are the connected components of verified links. Where a bucket still holds
several classes, the nodes outside of its largest class are compared with all nodes of other classes, each pair in the first bucket that
it shares, behind exact lower bounds of their distance. So a group of copies costs a multiple of its size, and nothing is capped. That two nodes have met
before is told by 32 bits of each key; a pair is passed over by a chance match about once in a million.

A text of up to ``k`` words is one k-mer, and a word replaced in the middle of fewer than 2 ``k`` words leaves no common k-mer. Texts of up to
2 ``k`` words therefore have keys of their wordings with one word deleted besides, which no pair at a distance of one word escapes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.text import names_apart
from quarry.operators.components import stars, with_roots
from quarry.runtime import BROADCAST_ROWS, arrow_batches, broadcast_if_small, discard, materialize

K = 5
BANDS = 64
PICKS = 2
SIMILARITY = 0.8
#: Bands whose buckets give each node its first leaders; most copies find their class by these.
FIRST_BANDS = 8
#: Leaders that a node outside of a bucket's largest class meets there, one after another, before all nodes meet.
LEADERS = 2
#: Nodes with signatures, of 300 bytes each, that are broadcast at most.
SIGNED_ROWS = 25_000
#: Bits of a text's signature, a parity for each hash of an occurrence-labelled word.
BITS = 2048

SLICE_ROWS = 256
#: Texts, and pairs of texts, that a Python worker gets at once.
TEXTS_AT_ONCE = 1_000
PAIRS_AT_ONCE = 500


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public: the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(words: list[str]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[str]:
    """Lower-cased words: maximal runs without white space."""
    return (text or "").lower().split()


def labelled_kmers(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """A hash for each k-mer and its occurrence number, in text order; a shorter text is one k-mer, an empty one has none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    kmers = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        kmers = (kmers + hashes[j : j + len(kmers)]) * np.uint64(0x9E3779B97F4A7C15)
        kmers ^= kmers >> np.uint64(29)
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if not fresh.all():
        places = np.arange(len(kmers))
        occurrence = np.empty(len(kmers), dtype=np.uint64)
        occurrence[order] = places - np.maximum.accumulate(np.where(fresh, places, 0))
        kmers = kmers + _mix(occurrence) * (occurrence > 0)
    return kmers


def sketch(hashes: np.ndarray, bands: int = BANDS, picks: int = PICKS, k: int = K) -> np.ndarray:
    """A bucket key for each band: the hash of the smallest labelled k-mers in their text order."""
    kmers = labelled_kmers(hashes, k)
    n = len(kmers)
    if not n:
        return np.empty(0, dtype=np.uint64)
    seeds = _mix(np.arange(1, bands + 1, dtype=np.uint64))
    # k-mers are mixed already, so multiplication by an odd number is order enough; ranks of 32 bits are quick to compare
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    factors = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    keys = []
    step = max(1, (1 << 22) // n)  # bands at once, to bound memory
    for at in range(0, bands, step):
        key = seeds[at : at + step]
        rows = np.arange(len(key))
        ranks = short[None, :] * factors[at : at + step, None]
        places = []
        for _ in range(min(picks, n)):
            places.append(ranks.argmin(axis=1))
            ranks[rows, places[-1]] = np.iinfo(np.uint32).max
        for place in np.sort(np.array(places), axis=0):
            key = _mix(key * np.uint64(31) + kmers[place])
        keys.append(key)
    return np.concatenate(keys)


def short_keys(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Keys of a text of up to 2 ``k`` words: its words, and its words but one; none for a longer or an empty text."""
    n = len(hashes)
    if not 0 < n <= 2 * k:
        return np.empty(0, dtype=np.uint64)
    kept = [hashes] + [np.delete(hashes, j) for j in range(n if n > 1 else 0)]
    return np.array([xxhash.xxh3_64_intdigest(some.tobytes(), seed=n) for some, n in zip(kept, map(len, kept), strict=True)], dtype=np.uint64)


def within_distance(a: list, b: list, most: int) -> int | None:
    """The edit distance of two sequences if it is at most ``most``, else None.

    Bit-parallel alignment over a diagonal band: bit d of the words stands for diagonal d of the band, and integers of arbitrary
    length hold it. Each step handles one element of ``b``; the band widens from a narrow one, as most copies differ little.
    """
    if len(a) < len(b):
        a, b = b, a
    front = 0
    limit = min(len(a), len(b))
    while front < limit and a[front] == b[front]:
        front += 1
    back = 0
    while back < limit - front and a[-1 - back] == b[-1 - back]:
        back += 1
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    if len(a) - len(b) > most:
        return None
    if not b:
        return len(a)
    band = max(8, len(a) - len(b))
    while True:
        band = min(band, most)
        found = _banded(a, b, band)
        if found <= band:
            return found
        if band >= most:
            return None
        band *= 4


def _banded(a: list, b: list, band: int) -> int:
    """Edit distance along paths that stay within ``band`` diagonals; a number above ``band`` if there is none so short.

    Column j covers rows j - band to j + band of ``a``. VP and VN hold the vertical differences +1 and -1 of neighbouring
    cells in a column; moving on by one column shifts the band down by one row, that is, the words right by one bit.
    """
    width = 2 * band + 1
    full = (1 << width) - 1
    top = 1 << (width - 1)
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    # bit r of column j is row j - band + r, 0-based in a, and compares a[row] with b[j]
    masks = {x: sum(1 << i for i in rows) if len(rows) < 8 else _bits(rows) for x, rows in where.items()}
    # before the first column: D(i, 0) = i, with i counted from the band's lowest row; rows above the matrix get no difference
    vp = (full >> band) << band
    vn = 0
    n, m = len(a), len(b)
    last = n - 1  # row whose value is wanted in the last column
    score = band  # value at the lowest row of the band
    for j in range(m):
        mask = masks.get(b[j], 0)
        shift = j - band
        eq = (mask >> shift if shift >= 0 else mask << -shift) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        # the band's lowest cell moves down a diagonal: it keeps its value if the diagonal step is free
        score += 0 if d0 & top else 1
        x = d0 >> 1
        vp = (hn | ~(x | hp)) & full
        vn = hp & x
    # from the lowest row of the last column, m - 1 + band, up to row n - 1
    low = m - 1 + band
    for row in range(low, last, -1):
        bit = 1 << (row - (m - 1 - band) - 1)
        score += -1 if vp & bit else 1 if vn & bit else 0
    return score


def _bits(rows: list[int]) -> int:
    flags = np.zeros(rows[-1] // 8 + 1, dtype=np.uint8)
    places = np.array(rows)
    np.bitwise_or.at(flags, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return int.from_bytes(flags.tobytes(), "little")


def similar(a: list[str], b: list[str], threshold: float) -> bool:
    """Whether the edit similarity, 1 - distance / longer length, of two lists of words reaches the threshold."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - threshold) + 1e-9)
    if a == b:
        return True
    if longer - min(len(a), len(b)) > most:
        return False
    counts: dict[str, int] = {}
    for word in a:
        counts[word] = counts.get(word, 0) + 1
    common = 0
    for word in b:
        left = counts.get(word, 0)
        if left:
            counts[word] = left - 1
            common += 1
    # words without a partner need an edit each, so this bound loses nothing
    return longer - common <= most and within_distance(a, b, most) is not None


def _fingerprint(text: Column) -> Column:
    """128 bits for a text; equal texts are one node."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _sketches(docs: DataFrame, id_col: str, text_col: str, bands: int, picks: int, k: int) -> DataFrame:
    """(id, fp, words, keys) for each row; keys are those of the bands, then those of a short text."""
    chosen = docs.select(F.col(id_col).alias("id"), _fingerprint(F.col(text_col)).alias("fp"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*chosen.schema.fields[:2], T.StructField("words", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                counts, keys = [], []
                for text in part.column("text").to_pylist():
                    hashes = hashes_of(words_of(text))
                    counts.append(len(hashes))
                    keys.append(np.concatenate((sketch(hashes, bands, picks, k), short_keys(hashes, k))).view(np.int64))
                arrays = [part.column("id"), part.column("fp"), pa.array(counts, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return chosen.mapInArrow(run, schema)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Bit b tells whether the number of occurrence-labelled words whose hash falls on b is odd.

    An added or deleted word adds or takes one labelled word, so it changes a single bit, and a replaced one two at most. So texts of
    m and n words whose signatures differ in d bits are at least (d + abs(m - n)) / 2 edits apart.
    """
    odd = np.bincount((labelled_kmers(hashes, 1) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(texts: DataFrame) -> DataFrame:
    """(node, words, signature) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                hashes = [hashes_of(words_of(text)) for text in part.column("text").to_pylist()]
                arrays = [part.column("node"), pa.array(map(len, hashes), pa.int32()), pa.array(map(signature, hashes), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "words", "signature"])

    return texts.select("node", "text").mapInArrow(run, "node long, words int, signature array<long>")


def _possible(a: str, b: str, threshold: float) -> Column:
    """Whether lengths and signatures of two nodes allow the similarity; exact lower bounds of their distance, so no link is lost."""
    words_a, words_b = F.col(f"{a}.words"), F.col(f"{b}.words")
    most = F.greatest(words_a, words_b) * (1 - threshold) + 1e-9

    def differ(parts: range) -> Column:
        return reduce(Column.__add__, (F.bit_count(F.col(f"{a}.signature")[j].bitwiseXOR(F.col(f"{b}.signature")[j])) for j in parts))

    apart = F.abs(words_a - words_b)
    # a quarter of the bits rules out most pairs
    return (apart <= most) & (differ(range(BITS // 256)) + apart <= 2 * most) & (differ(range(BITS // 64)) + apart <= 2 * most)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, linked) for each pair of nodes (a, b)."""
    wide = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    wide = wide.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                known: dict[int, list[str]] = {}
                linked = []
                columns = (part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
                for a, b, text_a, text_b in zip(*columns, strict=True):
                    for node, text in ((a, text_a), (b, text_b)):
                        if node not in known:
                            known[node] = words_of(text)
                    linked.append(similar(known[a], known[b], threshold))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return wide.mapInArrow(run, "a long, b long, linked boolean")


def _pairs(a: Column, b: Column) -> list[Column]:
    """Two different nodes as (a, b) with a > b."""
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


class _Classes:
    """Classes of the nodes that share a bucket, as verified links join them."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, threshold: float):
        """``sketches`` is (node, marks), 32 bits of the key of each band."""
        self.spark, self.threshold, self.sketches = texts.sparkSession, threshold, sketches
        with arrow_batches(self.spark, TEXTS_AT_ONCE):
            self.nodes = materialize(_signatures(texts), "nodes")
        self.signed = broadcast_if_small(self.nodes, SIGNED_ROWS)
        self.texts = texts
        #: (node, component) of all nodes but the one that names its class, the smallest
        self.components: DataFrame | None = None
        #: whether a count shows that these can be broadcast
        self.few = False

    def named(self, members: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
        """``members`` with the class of their ``node``: of one without a link, the node itself."""
        if self.components is None:
            return members.withColumn(component, F.col(node))
        known = self.components.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
        named = members.join(F.broadcast(known) if self.few else known, F.col(node) == F.col("__node"), "left")
        return named.withColumn(component, F.coalesce("__component", node)).drop("__node", "__component")

    def link(self, pairs: DataFrame, bounded: bool = False) -> None:
        """Compare pairs of nodes (a, b), and join the classes of those that are similar."""
        if not bounded:
            # a node may be in many pairs: where nodes are not broadcast, both sides of a join have a shuffle of their own, which adaptive execution can split
            a, b = (self.signed.select(*(F.col(c).alias(f"{c}_{x}") for c in self.signed.columns)) for x in "ab")
            wide = pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b"))
            sides = [F.struct(F.col(f"words_{x}").alias("words"), F.col(f"signature_{x}").alias("signature")).alias(f"of_{x}") for x in "ab"]
            pairs = wide.select("a", "b", *sides).where(_possible("of_a", "of_b", self.threshold)).select("a", "b")
        with arrow_batches(self.spark, PAIRS_AT_ONCE):  # two texts a row
            tested = materialize(_verified(pairs, self.texts, self.threshold), "tested")
        # links join classes, not nodes, so that what was joined before is not gone through again
        edges = self.named(self.named(tested.where("linked"), "a", "src"), "b", "dst").where("src <> dst").select("src", "dst")
        old = self.components
        if old is None:
            self.components = stars(edges)
        elif not edges.isEmpty():
            joined = stars(edges)
            # a node that names a class is in no row of the old ones
            moved = broadcast_if_small(joined.select(F.col("node").alias("component"), F.col("component").alias("into")))
            renamed = old.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
            self.components = materialize(renamed.union(joined), "classes")
            discard(joined, old)
        if self.components is not old:
            self.few = self.components.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        discard(tested)

    def mixed(self, members: DataFrame, turn: int = 0) -> tuple[DataFrame, DataFrame]:
        """``members`` (key, node, band) with their class, and (key, largest, leader, dominated) of the buckets of several classes.

        ``leader`` is a node of the largest class, which dominates a bucket if it holds half of its nodes. Hashes choose it, another one in each
        bucket and ``turn``, so that a node that shares several buckets with a class meets several of its nodes.
        """
        now = materialize(self.named(members), "named")
        sizes = now.groupBy("key", "component").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("leader"))
        several = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "leader")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("classes"))
        several = several.where("classes > 1").select(
            "key", F.col("top.component").alias("largest"), F.col("top.leader").alias("leader"), (F.col("top.n") * 2 >= F.col("all")).alias("dominated")
        )
        return now, materialize(several, "several")

    def lead(self, members: DataFrame, everywhere: bool = True, turn: int = 0) -> None:
        """Compare the nodes outside of a bucket's largest class with a node of it; if not ``everywhere``, in dominated buckets alone."""
        now, several = self.mixed(members, turn)
        led = several if everywhere else several.where("dominated")
        if not led.isEmpty():
            outside = now.join(broadcast_if_small(led), "key").where("component <> largest")
            self.link(outside.select(*_pairs(F.col("node"), F.col("leader"))).distinct())
        discard(now, several)

    def exhaust(self, members: DataFrame) -> None:
        """Compare the nodes outside of a bucket's largest class with all nodes of other classes in it.

        Two nodes that share several buckets meet in that of the first band alone: elsewhere, their marks of earlier bands have a match.
        """
        now, several = self.mixed(members)
        if several.isEmpty():
            return
        about = self.nodes.join(self.sketches, "node")
        full = now.join(broadcast_if_small(several.select("key", "largest")), "key").join(broadcast_if_small(about, 10_000), "node")
        # texts whose lengths allow the similarity are in the same bin or in neighbouring ones
        width = math.log(1 / self.threshold) * (1 + 1e-6)
        full = materialize(full.withColumn("bin", F.floor(F.log("words") / width)), "full")
        few = full.where("component <> largest")
        a = reduce(DataFrame.union, (few.withColumns({"step": F.lit(k), "wanted": F.col("bin") + k}) for k in (-1, 0, 1))).alias("a")
        b = full.alias("b")
        same = (F.col("a.key") == F.col("b.key")) & (F.col("a.wanted") == F.col("b.bin")) & (F.col("a.component") != F.col("b.component"))
        # nodes outside of the largest class on both sides meet once: those of neighbouring bins on the way up
        many = F.col("b.component") == F.col("b.largest")
        once = many | (F.col("a.step") == 1) | ((F.col("a.step") == 0) & (F.col("a.node") > F.col("b.node")))
        earlier = F.arrays_overlap(*(F.slice(F.col(f"{x}.marks"), F.lit(1), F.col(f"{x}.band")) for x in "ab"))
        self.link(a.join(b, same & once & _possible("a", "b", self.threshold) & ~earlier).select(*_pairs(F.col("a.node"), F.col("b.node"))).distinct(), bounded=True)
        discard(now, several, full)


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, picks: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of each row, and (fp, first, copies, component) of the texts that have copies or a link to another text.

    ``first`` is the struct (n, i) of the smallest id: whether it is null, and the id.
    """
    ident = F.col("id")
    with arrow_batches(docs.sparkSession, TEXTS_AT_ONCE):
        rows = materialize(_sketches(docs, id_col, text_col, bands, picks, k), "sketches")
    distinct = rows.groupBy("fp").agg(
        F.first("words").alias("words"), F.first("keys").alias("keys"), F.count("*").alias("copies"), F.min(F.struct(ident.isNull().alias("n"), ident.alias("i"))).alias("first")
    )
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "texts")
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
    buckets = materialize(buckets, "buckets")
    members = keyed.join(broadcast_if_small(buckets.where("n > 2").select("key")), "key", "left_semi")
    members = materialize(members, "members")
    paired = buckets.select(F.explode(F.array("low", "high")).alias("node"))
    sharing = materialize(paired.union(members.select("node")).distinct(), "sharing")
    wanted = materialize(nodes.select("fp", "node").join(broadcast_if_small(sharing), "node", "left_semi"), "wanted")
    texts = docs.select(_fingerprint(F.col(text_col)).alias("fp"), F.col(text_col).cast("string").alias("text")).join(broadcast_if_small(wanted), "fp")
    texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "wordings")

    marks = F.transform(F.slice("keys", 1, bands), lambda key: F.shiftright(key, 32).cast("int"))
    classes = _Classes(texts, nodes.select("node", marks.alias("marks")), threshold)
    classes.link(buckets.select(*_pairs(F.col("low"), F.col("high"))).distinct())
    if bands > FIRST_BANDS:
        classes.lead(members.where(F.col("band") < FIRST_BANDS))
    for turn in range(1, LEADERS + 1):
        classes.lead(members, turn=turn)
    classes.exhaust(members)
    named = materialize(with_roots(classes.components), "classes")
    slim = nodes.select("node", "fp", "first", "copies").join(broadcast_if_small(named), "node", "left")
    linked = materialize(slim.where("component is not null or copies > 1").withColumn("component", F.coalesce("component", "node")), "linked")
    discard(nodes, buckets, members, sharing, wanted, texts, classes.nodes, classes.components, named)
    return rows.select("id", "fp"), linked


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    picks: int = PICKS,
    k: int = K,
) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, class_id (the smallest id of its class), class_size (rows).

    Two texts are linked if the edit similarity of their lower-cased words, 1 - distance / length of the longer, is at least
    ``threshold`` and they share a bucket: one of ``bands`` sketches of ``picks`` ordered k-mers, or a wording of up to
    2 ``k`` words but one. A class is whatever links connect. Equal texts are always in one class, empty and null ones (which are equal) too.
    A class whose ids are all null has a null class_id. Other columns are ignored. No rows give no rows.
    """
    rows, linked = _classes(docs, id_col, text_col, threshold, bands, picks, k)
    sizes = linked.groupBy("component").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    # a large class can be split in these joins, as both sides of them are read anew
    known = linked.select("fp", "component").join(broadcast_if_small(materialize(sizes, "sizes")), "component").select("fp", "first", "class_size")
    named = rows.join(broadcast_if_small(materialize(known, "known")), "fp", "left")
    single = F.col("class_size").isNull()
    return named.select(F.col("id").alias(id_col), F.when(single, F.col("id")).otherwise(F.col("first.i")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


@names_apart
def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    picks: int = PICKS,
    k: int = K,
) -> DataFrame:
    """One row of each class of :func:`near_duplicates`, with all columns of ``docs``: the row with the smallest id (null last).

    Rows with texts of their own pass without a shuffle of texts.
    """
    rows, linked = _classes(docs, id_col, text_col, threshold, bands, picks, k)
    keepers = materialize(linked.groupBy("component").agg(F.min(F.struct("first", "fp")).alias("keep")), "keepers")
    marked = linked.join(broadcast_if_small(keepers), "component").withColumn("lost", F.col("keep.fp") != F.col("fp")).where("lost or copies > 1")
    marks = materialize(marked.select(F.col("fp").alias("__fp"), F.col("lost").alias("__lost")), "marks")
    tagged = docs.withColumn("__fp", _fingerprint(F.col(text_col))).join(broadcast_if_small(marks), "__fp", "left")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"))
    merged = tagged.where("not __lost").groupBy("__fp").agg(F.min_by(row, order).alias("__row")).select("__row.*")
    return tagged.where("__lost is null").select(*(f"`{c}`" for c in docs.columns)).union(merged)
