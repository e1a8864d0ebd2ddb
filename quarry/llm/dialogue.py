"""Repair of the turn structure of conversations by a dynamic program over retained turns.

A repaired conversation is empty, or an optional system turn and then user and assistant turns in alternation. A turn is kept, given another role
or deleted, and empty turns are inserted. The program chooses the subsequence of turns to retain: from one retained turn to the next, the
turns between are deleted, which costs a difference of prefix sums, and the two roles alone determine what is inserted. So the best continuation
for a next turn of a role is a running minimum over later turns, one for each role, and a turn takes a few steps. Of the cheapest edits, those
whose letters (D, I, K, R) are least as text are taken: going forward, the longest run of deletions, then the most insertions, then keeping.

Conversations may be of any length. Rows are sorted by ranges, and the rows of a conversation in one range are a segment. A conversation of several
segments, of which there are no more than ranges, is solved by its segments' costs from each role to each role: their products from the
back price what follows a segment, the walk through it then leads from each role to one role, and so every segment learns where it begins. What
reaches the driver of a segment is a few numbers.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.prefix import range_sorted
from quarry.runtime import arrow_batches, broadcast_if_small, materialize

#: The costs of edits, and of retaining a truncated turn.
DELETE, REROLE, INSERT, TRUNCATED_KEPT = 2, 1, 5, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: White-space characters of the contract.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Characters of a text that rows with equal turn and role are sorted by.
HEAD = 256
ROWS_AT_ONCE = 10_000
#: Rows with texts that a Python worker gets at once.
TEXTS_AT_ONCE = 500

#: The role before the first retained turn, and the roles that may be retained.
NONE, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "-sua"
#: What is inserted between a role and the next; a pair that is not here cannot be mended.
BETWEEN = {
    (NONE, SYSTEM): "", (NONE, USER): "", (NONE, ASSISTANT): "u", (SYSTEM, USER): "", (SYSTEM, ASSISTANT): "u",
    (USER, USER): "a", (USER, ASSISTANT): "", (ASSISTANT, USER): "", (ASSISTANT, ASSISTANT): "u",
}
#: What is inserted after the last role.
AFTER = ["", "ua", "a", ""]
END_COSTS = [INSERT * len(some) for some in AFTER]
FAR = 2**60
_STEPS = {r: [(q, len(some)) for (p, q), some in BETWEEN.items() if p == r] for r in range(4)}


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) of damaged rows, nulls of role and text being one space, as well as in the key ``conv_id:turn``.

    The CRC-32 of the key modulo 20 decides: 0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4
    makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).cast("int").alias("fault"),
    )
    fault = F.col("fault")
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    return rows.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def solve(codes: bytes, ends: list[int]) -> tuple[list[int], list[tuple[array, array]]]:
    """Costs of a segment from each role before it, and the tables to walk by.

    A code is a turn's role (0 if it may not be kept) plus four times its fault; ``ends`` prices what follows each last role. For each role there are the
    best cost and place of the next retained turn that gets this role, from every place on; costs are counted from the segment's start with all
    turns before it deleted.
    """
    n = len(codes)
    least, where = [FAR] * 4, [n] * 4
    costs, places = [array("q", [FAR]) * (n + 1) for _ in range(4)], [array("q", [n]) * (n + 1) for _ in range(4)]

    def onward(role: int) -> int:
        return min([ends[role] + DELETE * n, *(least[q] + INSERT * k for q, k in _STEPS[role])])

    for j in range(n - 1, -1, -1):
        fault, own = codes[j] >> 2, codes[j] & 3
        if fault not in (BLANK, DUPLICATE):
            extra = (TRUNCATED_KEPT if fault == TRUNCATED else 0) - DELETE
            # retained here: all turns before it deleted, itself and those behind it as they are best
            found = [(role, onward(role) + extra + (own != role) * REROLE) for role in (SYSTEM, USER, ASSISTANT) if role != SYSTEM or own == SYSTEM]
            for role, cost in found:
                if cost < min(least[role], FAR // 2):  # of equal ones the later stays: more deletions come first
                    least[role], where[role] = cost, j
        for role in (SYSTEM, USER, ASSISTANT):
            costs[role][j], places[role][j] = least[role], where[role]
    return [cost if cost < FAR // 2 else FAR for cost in map(onward, range(4))], list(zip(costs, places, strict=True))


def walk(codes: bytes, ends: list[int], tables: list[tuple[array, array]], role: int, last: bool) -> tuple[str, str, int]:
    """(letters, initials of the repaired turns, last role) of the least of the cheapest edits that begin after ``role``."""
    n, i = len(codes), 0
    letters, initials = [], []
    while True:
        best = (ends[role] + DELETE * n, -n, 0, "", role)
        for q, k in _STEPS[role]:
            j = tables[q][1][i]
            if j < n:
                best = min(best, (tables[q][0][i] + INSERT * k, -j, -k, "K" if codes[j] & 3 == q else "R", q))
        _, j, k, letter, q = best
        letters.append("D" * (-j - i))
        if not letter:
            break
        letters.append("I" * -k + letter)
        initials.append(BETWEEN[role, q] + INITIALS[q])
        i, role = 1 - j, q
    if last:
        letters.append("I" * len(AFTER[role]))
        initials.append(AFTER[role])
    return "".join(letters), "".join(initials), role


def cost_of(codes: bytes, letters: str) -> int:
    """What these edits of a segment cost."""
    sums = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}
    retained = [x in "KR" for x in letters if x != "I"]
    return sum(map(sums.get, letters)) + sum(TRUNCATED_KEPT for x, code in zip(retained, codes, strict=True) if x and code >> 2 == TRUNCATED)


def _per_segment(coded: DataFrame, columns: dict[str, pa.DataType], make: Callable[..., tuple]) -> DataFrame:
    """A row (range, conv_id, and ``columns``) for each segment: what ``make`` gives for its key, codes, turns [least, greatest, distinct] and first place."""
    fields = T.StructType([T.StructField("range", T.LongType()), coded.schema["conv_id"], *(T.StructField(c, _KINDS[kind]) for c, kind in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codes, turns, first, ready = None, bytearray(), [], 0, []

        def given(kind: pa.DataType) -> pa.RecordBatch:
            kinds = [pa.int64(), kind, *columns.values()]
            made = pa.RecordBatch.from_arrays([pa.array([row[k] for row in ready], some) for k, some in enumerate(kinds)], names=fields.names)
            ready.clear()
            return made

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, place, code, turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "code", "turn")), strict=True):
                if key != (place >> 33, conv):
                    if key:
                        ready.append((*key, *make(key, bytes(codes), turns, first)))
                    key, codes, turns, first = (place >> 33, conv), bytearray(), [], place
                codes.append(code)
                if turn is not None and not turns:
                    turns = [turn, turn, 1]
                elif turn is not None and turn != turns[1]:
                    turns[1:] = turn, turns[2] + 1
            yield given(kind)
        if key:
            ready.append((*key, *make(key, bytes(codes), turns, first)))
            yield given(kind)

    with arrow_batches(coded.sparkSession, ROWS_AT_ONCE):
        dealt = coded.repartition("range").sortWithinPartitions("place").select("conv_id", "place", "code", "turn")
        return materialize(dealt.mapInArrow(run, fields), "segments")


_KINDS = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.list_(pa.int64()): T.ArrayType(T.LongType())}


def _starts(coded: DataFrame) -> dict[tuple, tuple[int, list[int], bool]]:
    """For each segment of a conversation with several: the role before it, what follows each role after it, and whether it is the last.

    There are two such segments for each range at most, so they are few however long a conversation is.
    """
    ends = coded.groupBy("range").agg(F.min(F.struct("place", "conv_id")).alias("low"), F.max(F.struct("place", "conv_id")).alias("high")).orderBy("range").collect()
    several = list(dict.fromkeys(b["low"]["conv_id"] for a, b in zip(ends, ends[1:], strict=False) if a["high"]["conv_id"] == b["low"]["conv_id"]))
    if not several:
        return {}
    named = coded.sparkSession.createDataFrame([(c,) for c in several], T.StructType([T.StructField("several", coded.schema["conv_id"].dataType)]))
    parts = coded.join(F.broadcast(named), F.col("conv_id").eqNullSafe(F.col("several")), "left_semi")

    def prices(key: tuple, codes: bytes, turns: list[int], first: int) -> tuple:
        ways = [solve(codes, [0 if q == end else FAR for q in range(4)])[0] for end in range(4)]
        return ([ways[end][role] for role in range(4) for end in range(4)],)

    priced = defaultdict(list)
    for row in _per_segment(parts, {"prices": pa.list_(pa.int64())}, prices).orderBy("range").collect():
        priced[row["conv_id"]].append((row["range"], row["prices"]))
    following: dict[tuple, list[int]] = {}
    for conv, own in priced.items():
        after = END_COSTS
        for at, ways in reversed(own):
            following[at, conv] = after
            after = [min(ways[4 * role + end] + after[end] for end in range(4)) for role in range(4)]

    def leads(key: tuple, codes: bytes, turns: list[int], first: int) -> tuple:
        after = following[key]
        tables = solve(codes, after)[1]
        return ([walk(codes, after, tables, role, False)[2] for role in range(4)],)

    led = {(row["range"], row["conv_id"]): row["leads"] for row in _per_segment(parts, {"leads": pa.list_(pa.int64())}, leads).collect()}
    starts = {}
    for conv, own in priced.items():
        role = NONE
        for at, _ in own:
            starts[at, conv] = (role, following[at, conv], at == own[-1][0])
            role = led[at, conv][role]
    return starts


def _coded(placed: DataFrame) -> DataFrame:
    """(conv_id, range, place, turn, code) of the rows in order."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    own = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    plain = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    rows = placed.select("conv_id", "place", "turn", "wording", own.alias("own"), plain.alias("plain"))
    # only wordings that a conversation repeats meet their first row
    repeated = rows.where(F.col("plain") != BLANK).groupBy("wording").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(broadcast_if_small(materialize(repeated, "repeated")), "wording", "left")
    fault = F.when((F.col("plain") != BLANK) & (F.col("place") > F.col("earliest")), DUPLICATE).otherwise(F.col("plain"))
    code = (F.col("own") + fault * 4).cast("int")
    return materialize(rows.select("conv_id", F.shiftright("place", 33).alias("range"), "place", "turn", code.alias("code")), "coded")


def _legal(first: int | Column, second: int | Column) -> Column | bool:
    """Whether these roles may be neighbours."""
    pair = first * 10 + second
    allowed = (SYSTEM * 10 + USER, USER * 10 + ASSISTANT, ASSISTANT * 10 + USER)
    return pair.isin(*allowed) if isinstance(pair, Column) else pair in allowed


def _edited(segments: DataFrame) -> DataFrame:
    """(conv_id, position, place, edit, initial) of each turn that is retained (with the place of its row) or inserted (without)."""
    fields = T.StructType([segments.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in ("position", "place")), *(T.StructField(c, T.StringType()) for c in ("edit", "initial"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # all segments of the batch at once, as most are short
            texts = batch.column("letters").to_pylist()
            letter = np.frombuffer("".join(texts).encode(), np.uint8)
            sizes = np.array([len(t) for t in texts], np.int64)
            start = np.cumsum(sizes) - sizes
            own = np.repeat(np.arange(len(texts)), sizes)
            takes = letter != ord("I")
            before = np.cumsum(takes) - takes
            first, at = (batch.column(c).to_numpy() for c in ("first", "range"))
            place = (first - before[np.minimum(start, max(0, len(letter) - 1))])[own] + before if len(letter) else before
            position = (at[own] << 33) + np.arange(len(letter)) - start[own]
            kept = letter != ord("D")
            edit = pa.array(letter[kept].view("S1").astype(str), pa.string())
            initial = pa.array(np.frombuffer("".join(batch.column("initials").to_pylist()).encode(), "S1").astype(str), pa.string())
            arrays = [batch.column("conv_id").take(pa.array(own[kept])), pa.array(position[kept]), pa.array(place[kept], mask=~takes[kept]), edit, initial]
            yield pa.RecordBatch.from_arrays(arrays, names=fields.names)

    return segments.select("conv_id", "range", "first", "letters", "initials").mapInArrow(run, fields)


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation of ``rows``, and its cheapest repair.

    A conversation's rows are taken by turn (nulls first; ties by role, the first 256 characters of the text, a hash of it). Null roles and texts count as one
    space, repeated rows as often as they are there; a null conversation id is one conversation. Other columns are ignored.

    The first result has a row for each conversation: conv_id, gaps (missing turn numbers; 0 without numbers, or if 64 bits cannot hold them), blank, duplicate and truncated
    (rows by their first fault), illegal (neighbours whose role initials are not su, ua or au), cost, and audit, the letters of the edits. Keeping
    a turn costs 0, giving it the role user or assistant 1, deleting it 2, inserting an empty turn 5; a truncated turn that is retained adds 5, and
    blank and duplicate ones must go, as must, or be given another role, a turn whose initial is not s, u or a.

    The second has the repaired turns: conv_id, position (rising within a conversation), turn (null if inserted), role, text, edit (K, R or I).
    No rows give no rows.
    """
    space = F.lit(" ")
    chosen = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
    )
    # a wording is a conversation's own, so that one that all conversations share is no hot key
    ident = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    chosen = chosen.withColumn("wording", F.unhex(F.md5(F.concat_ws("\0", ident, "role", "text").cast("binary"))))
    placed = range_sorted(chosen, [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, HEAD), F.col("wording")], ["conv_id"])
    coded = _coded(placed)
    starts = _starts(coded)

    def solved(key: tuple, codes: bytes, turns: list[int], first: int) -> tuple:
        role, ends, last = starts.get(key, (NONE, END_COSTS, True))
        letters, initials, _ = walk(codes, ends, solve(codes, ends)[1], role, last)
        faults = [code >> 2 for code in codes]
        own = [code & 3 for code in codes]
        illegal = sum(not _legal(a, b) for a, b in zip(own, own[1:], strict=False))
        return (first, letters, initials, cost_of(codes, letters), *(faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)), illegal, own[0], own[-1], *(turns or [None, None, 0]))

    numbers = ("cost", "blank", "duplicate", "truncated", "illegal", "head", "tail", "least", "greatest", "turns")
    segments = _per_segment(coded, {"first": pa.int64(), "letters": pa.string(), "initials": pa.string(), **dict.fromkeys(numbers, pa.int64())}, solved)

    # segments of a conversation, of which there are no more than ranges, meet their neighbours
    before = Window.partitionBy("conv_id").orderBy("range")
    joined = segments.withColumns(
        {"seam": F.coalesce(~_legal(F.lag("tail").over(before), F.col("head")), F.lit(False)).cast("long"), "shared": F.coalesce(F.lag("greatest").over(before) == F.col("least"), F.lit(False)).cast("long")}
    )
    wide = "decimal(38,0)"
    gaps = F.max("greatest").cast(wide) - F.min("least").cast(wide) + 1 - (F.sum("turns") - F.sum("shared")).cast(wide)
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "letters"))), lambda x: x["letters"]), "")
    report = joined.groupBy("conv_id").agg(
        F.coalesce(gaps.try_cast("long"), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        (F.sum("illegal") + F.sum("seam")).alias("illegal"),
        F.sum("cost").alias("cost"),
        letters.alias("audit"),
    )

    edited = materialize(_edited(segments), "edited")
    texts = placed.select("place", "turn", F.col("role").alias("had"), "text")
    given = F.when(F.col("initial") == "u", F.lit("user")).otherwise(F.lit("assistant"))
    kept = edited.where("place is not null").join(texts, "place")
    kept = kept.select("conv_id", "position", "turn", F.when(F.col("edit") == "K", F.col("had")).otherwise(given).alias("role"), "text", "edit")
    added = edited.where("place is null").select("conv_id", "position", F.lit(None).cast("long").alias("turn"), given.alias("role"), F.lit("").alias("text"), "edit")
    return report, kept.union(added)


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of a conversation's ``role:text`` lines, joined by newlines.

    A hash of this kind has one state, so a conversation's turns pass through one task in order, a batch at a time; none is held.
    """
    fields = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, kind = None, None, None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            done = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    state, current = hashlib.sha256(), conv
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=fields.names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([state.hexdigest()])], names=fields.names)

    with arrow_batches(repaired.sparkSession, TEXTS_AT_ONCE):
        dealt = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "role", "text")
        return materialize(dealt.mapInArrow(run, fields), "digests")


def full_report(conversations: DataFrame, report: DataFrame, digests: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row for every conversation of ``conversations``, also those that have no row left: zeros, an empty audit, the hash of an empty string."""
    found = F.struct(*report.columns[1:])
    none = F.lit(None)
    rows = report.select("conv_id", found.alias("found"), none.cast("string").alias("digest"))
    rows = rows.union(digests.select("conv_id", none.cast(rows.schema["found"].dataType), "repaired_sha256"))
    rows = rows.union(conversations.select(F.col(conv_col).alias("conv_id"), none.cast(rows.schema["found"].dataType), none.cast("string")).distinct())
    one = rows.groupBy("conv_id").agg(F.first("found", ignorenulls=True).alias("found"), F.first("digest", ignorenulls=True).alias("digest"))
    zero = [F.coalesce(f"found.{c}", F.lit(0)).cast("long").alias(c) for c in report.columns[1:-1]]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return one.select("conv_id", *zero, F.coalesce("found.audit", F.lit("")).alias("audit"), F.coalesce("digest", empty).alias("repaired_sha256"))
