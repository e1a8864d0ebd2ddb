"""Order-preserving packing of documents into token windows by dynamic programming.

Documents stay in the order in which the scan delivers them. In each scan partition, blocks of tokens are cut into windows of
at most ``capacity`` tokens. A window costs its padding, a fixed overhead and a truncation penalty for where it ends: nothing
at a document's end, little at a sentence's end. Only where such ends lie further apart than a window may be long, a window may end inside
a sentence, at a higher penalty. With g(i) = cost(i) + position(i), the best cut before
position p is the minimum of g over a sliding range of positions, which a monotone queue yields in constant amortised time;
a window whose length is a power of two has no padding and is tried besides. Only a partition's last window can be poorly
filled, so no shuffle is needed at any size, and memory is bounded by one block and one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.text import token_encoder

#: Documents that are turned into Python strings at once.
SLICE_ROWS = 256


def window_cuts(
    positions: list[int], penalties: list[float], capacity: int, overhead: float, open_end: bool = False, powers: bool = True
) -> list[int]:
    """The cheapest cuts among ``positions`` (ascending, the first is 0), neighbours at most ``capacity`` apart.

    Returns indices of positions, from 0 to the last one; with ``open_end``, to the best one among those closer than
    ``capacity`` to the end, as more tokens follow.
    """
    n = len(positions)
    total = positions[-1]
    at = [-1] * (total + 1)
    for k, p in enumerate(positions):
        at[p] = k
    lengths = [1 << k for k in range(capacity.bit_length()) if 1 << k < capacity] if powers else []
    cost, back = [0.0] * n, [0] * n
    queue, head = [0], 0  # indices with rising g
    g = [0.0] * n
    g[0] = float(positions[0])
    for j in range(1, n):
        p = positions[j]
        low = p - capacity
        while positions[queue[head]] < low:
            head += 1
        i = queue[head]
        best, source = g[i] + capacity - p, i
        for length in lengths:
            if length > p:
                break
            k = at[p - length]
            if k >= 0 and cost[k] < best:
                best, source = cost[k], k
        best += overhead + penalties[j]
        cost[j], back[j] = best, source
        g[j] = value = best + p
        while len(queue) > head and g[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
        if head > 4096:
            del queue[:head]
            head = 0
    last = n - 1
    if open_end:
        near = [j for j in range(1, n) if positions[j] > total - capacity]
        last = min(near, key=lambda j: cost[j] + overhead * (total - positions[j]) / capacity)
    cuts = [last]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class _Block:
    """Tokens of consecutive documents that are not yet cut into windows."""

    def __init__(self, encoder, capacity: int, costs: tuple[float, float, float], grid: int, first_sequence: int):
        self.ends, self.starts = encoder.sentence_tables()
        self.capacity, self.costs, self.grid, self.sequence = capacity, costs, grid, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # id, tokens of the whole document, tokens of it before this block
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray, skipped: int = 0, whole: int | None = None) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids) if whole is None else whole, skipped))
        self.tokens += len(ids)

    def candidates(self, ids: np.ndarray, bounds: np.ndarray, final: bool) -> tuple[list[int], list[float]]:
        """Positions at which a window may end, with their penalties."""
        _, sentence, inside = self.costs
        n = len(ids)
        known = np.minimum(ids, len(self.ends) - 1)
        ends = self.ends[known]
        follows = np.append(self.starts[known[1:]], True)
        penalty = np.full(n + 1, np.inf)
        penalty[1:][(ends == 2) | ((ends == 1) & follows)] = sentence
        penalty[bounds] = 0
        ended = final or penalty[n] < np.inf
        penalty[0] = penalty[n] = 0
        natural = np.flatnonzero(np.isfinite(penalty))
        for low, high in zip(natural[:-1], natural[1:], strict=True):
            if high - low > self.capacity:
                penalty[low + self.grid : high : self.grid] = inside
        if not ended:  # more of the sentence follows
            penalty[n] = np.inf
        chosen = np.flatnonzero(np.isfinite(penalty))
        return chosen.tolist(), penalty[chosen].tolist()

    def cut(self, final: bool) -> dict[str, pa.Array] | None:
        """Columns of the pieces of all complete windows; the rest of the tokens stay."""
        if not self.tokens:
            return None
        ids = np.concatenate(self.ids).astype("<u4", copy=False)
        first = np.cumsum([0, *map(len, self.ids)])
        begun = [d[2] == 0 for d in self.docs[1:]]
        positions, penalties = self.candidates(ids, first[1:-1][begun], final)
        cuts = np.array([positions[k] for k in window_cuts(positions, penalties, self.capacity, self.costs[0], open_end=not final)])
        stop = int(cuts[-1])
        pieces = np.union1d(cuts, first[(first > 0) & (first < stop)])
        begin, length = pieces[:-1], np.diff(pieces)
        doc = np.searchsorted(first, begin, side="right") - 1
        window = np.searchsorted(cuts, begin, side="right") - 1
        skipped = np.array([d[2] for d in self.docs])
        whole = np.array([d[1] for d in self.docs])
        columns = {
            "doc_id": [self.docs[k][0] for k in doc],
            "start": begin - first[doc] + skipped[doc],
            "length": length,
            "ids": pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((pieces * 4).astype("<i4")), pa.py_buffer(ids[:stop].tobytes())]),
            "doc_tokens": whole[doc],
            "sequence_id": self.sequence + window,
            "offset": begin - cuts[window],
        }
        self.sequence += len(cuts) - 1
        left = [(self.docs[k], self.ids[k], int(first[k])) for k in range(len(self.docs)) if first[k + 1] > stop]
        self.ids, self.docs, self.tokens = [], [], 0
        for (doc_id, tokens, before), own, at in left:
            gone = max(0, stop - at)
            self.add(doc_id, own[gone:].copy(), before + gone, tokens)
        return columns


def pack_windows(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: float = 64.0,
    sentence_penalty: float = 2.0,
    inside_penalty: float = 12.0,
    grid: int = 64,
    block_tokens: int = 1 << 19,
) -> DataFrame:
    """Pieces of documents in windows: ``id_col``, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers; every document ends with ``end_id``.
    ``start`` counts the document's ids before the piece, ``offset`` the window's. Penalties are in padded tokens;
    ``grid`` is the distance of cut positions inside sentences longer than a window. Sequence ids are unique, in order within a scan
    partition and not gapless.

    A null text counts as empty: one piece with ``end_id`` alone. Null ids and repeated rows are packed like others; rows are
    never merged. A text of any length is encoded whole and handed to blocks in parts, so that a worker holds a block and one
    document. Equal costs go to the later cut. Columns other than the two named ones are ignored, whatever their names. No rows give no pieces.
    """
    if capacity < 2 or block_tokens < 2 * capacity or not 0 < grid <= capacity:
        raise ValueError("capacity of 2 or more, blocks of two windows or more, and a grid within a window are needed")
    # the input's id column may have any name, also one of the output's
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = chosen.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            *(T.StructField(c, T.LongType()) for c in ("start", "length")),
            T.StructField("ids", T.BinaryType()),
            *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_encoder(tokenizer)
        end = np.array([end_id], dtype=np.uint32)
        block = _Block(encoder, capacity, (overhead, sentence_penalty, inside_penalty), grid, TaskContext.get().partitionId() << 32)
        kind = None

        def pack(final: bool) -> Iterator[pa.RecordBatch]:
            if columns := block.cut(final):
                arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=kind if k == "doc_id" else pa.int64()) for k, v in columns.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(columns))

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [text or "" for text in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    whole = np.concatenate((ids, end))
                    for begin in range(0, len(whole), block_tokens):
                        block.add(doc_id, whole[begin : begin + block_tokens], begin, len(whole))
                        if block.tokens >= block_tokens:
                            yield from pack(False)
        yield from pack(True)

    out = chosen.mapInArrow(run, schema)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
