"""Best-fit-decreasing packing of token ids into fixed rows, for files of ids.

Documents longer than a row are split without loss: their full rows are final at once, the rests compete with other
documents. Within a block of documents, pieces are placed in order of falling length, each into the open row with the least
room that still holds it; a segment tree over the rooms finds that row. A block's rows are written as one id matrix.
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

SLICE_ROWS = 256


class RoomTree:
    """Numbers of open rows by room, 0 to ``capacity``; a segment tree of counts with search for the least room that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def least(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open row has."""
        node, count = need + self.leaves, self.count
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """A row for each piece; rows are numbered in order of opening. Equal lengths keep their order."""
    tree = RoomTree(capacity)
    by_room: dict[int, list[int]] = {}
    rows = [0] * len(lengths)
    opened = 0
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[piece]
        room = tree.least(size)
        if room is None:
            row, opened, room = opened, opened + 1, capacity
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
        rows[piece] = row
        if room > size:
            by_room.setdefault(room - size, []).append(row)
            tree.add(room - size, 1)
    return rows


def pack_matrix(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = 1 << 21,
) -> DataFrame:
    """One row for each packed row: sequence_id, used, ids, cu_seqlens, position_resets, doc_ids, starts, doc_tokens.

    ``ids`` are ``capacity`` little-endian unsigned 32-bit integers, padded with ``pad_id`` after the first ``used``. cu_seqlens
    holds the cumulative segment lengths from 0 to ``used``; position_resets, for each segment, the place in the row at which positions
    start from 0 again; doc_ids, starts and doc_tokens, each segment's document, the number of its ids before the segment, and its
    ids in all. Each document ends with ``end_id``; every id lies in exactly one segment.

    A null text counts as empty: one segment with ``end_id``. Null ids and repeated rows are packed like others; other columns
    are ignored. No rows give no rows. Blocks bound memory: a worker holds ``block_tokens`` ids and one document. A text longer than
    ``capacity``, however long, is encoded whole and cut into full segments and a rest, which are packed apart.
    """
    if capacity < 1 or block_tokens < capacity:
        raise ValueError("a block holds at least one row of at least one id")
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("used", T.IntegerType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("position_resets", T.ArrayType(T.IntegerType())),
            T.StructField("doc_ids", T.ArrayType(chosen.schema["doc_id"].dataType)),
            T.StructField("starts", longs),
            T.StructField("doc_tokens", longs),
        ]
    )

    def pack(pieces: list[tuple], first: int, kind: pa.DataType) -> pa.RecordBatch:
        rows = best_fit_decreasing([len(p[3]) for p in pieces], capacity)
        segments: list[list[int]] = [[] for _ in range(max(rows) + 1)]
        for k, row in enumerate(rows):
            segments[row].append(k)
        matrix = np.full((len(segments), capacity), pad_id, dtype="<u4")
        ends = []
        for row, own in enumerate(segments):
            joined = np.concatenate([pieces[k][3] for k in own])
            matrix[row, : len(joined)] = joined
            ends.append(np.cumsum([0, *(len(pieces[k][3]) for k in own)]).tolist())
        offsets = (np.arange(len(segments) + 1) * capacity * 4).astype("<i4")
        arrays = [
            pa.array(np.arange(first, first + len(segments)), pa.int64()),
            pa.array([e[-1] for e in ends], pa.int32()),
            pa.Array.from_buffers(pa.binary(), len(segments), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())]),
            pa.array(ends, pa.list_(pa.int32())),
            pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
            pa.array([[pieces[k][0] for k in own] for own in segments], pa.list_(kind)),
            pa.array([[pieces[k][1] for k in own] for own in segments], pa.list_(pa.int64())),
            pa.array([[pieces[k][2] for k in own] for own in segments], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_encoder(tokenizer)
        end = np.array([end_id], dtype=np.uint32)
        sequence = TaskContext.get().partitionId() << 32
        pieces: list[tuple] = []
        tokens, kind = 0, None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [text or "" for text in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    whole = np.concatenate((ids, end))
                    for begin in range(0, len(whole), capacity):
                        piece = whole[begin : begin + capacity]
                        pieces.append((doc_id, begin, len(whole), piece))
                        tokens += len(piece)
                        if tokens >= block_tokens:
                            packed = pack(pieces, sequence, kind)
                            sequence, pieces, tokens = sequence + packed.num_rows, [], 0
                            yield packed
        if pieces:
            yield pack(pieces, sequence, kind)

    return chosen.mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: the id matrix as fixed-width binaries beside segment lengths and position resets."""
    packed.write.mode("overwrite").parquet(path)


def read_matrix(rows: list, capacity: int) -> np.ndarray:
    """The id matrix of some collected rows of a packed table."""
    return np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), dtype="<u4").reshape(len(rows), capacity)
