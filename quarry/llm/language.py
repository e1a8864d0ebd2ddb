"""Language identification by cross-parsing entropy.

A language is a sample of labelled text, held as a suffix automaton. A text is parsed against it from left to right into phrases, each the
longest match with any place of the sample; where no symbol matches, that symbol is a phrase. A phrase costs the bits of a place in the sample, so phrases
times log2(sample length) over the text's length estimate the cross entropy (Ziv and Merhav), and the language that needs fewest bits wins.

Texts are parsed as UTF-8 bytes of lower-cased letters with single spaces between words, so that an automaton has few symbols in any script. They
are parsed in blocks, all blocks and languages of a slice of texts at once by array look-ups; a phrase ends at a block's end in every
language alike. Texts stay where they are: scoring has no shuffle, and memory is that of the automata and of one slice of texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.runtime import arrow_batches, materialize

#: A language's sample: so many pieces of different texts at most, of so many characters at most.
PIECES = 128
PIECE_CHARS = 256
#: Characters of all samples together at most; with more languages each has fewer pieces, one at least.
SAMPLE_CHARS = 2**19
#: Bytes that are parsed as one sequence.
BLOCK = 1024
#: Bytes of text that a task parses at once, divided by the number of languages.
SLICE_BYTES = 2**24
TEXTS_AT_ONCE = 500
UNKNOWN = "und"

#: ASCII letters stay, other ASCII becomes a space, and bytes of other characters stay.
_KEPT = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def is_held_out(ident: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether the CRC-32 of the id as text (null: empty) has this remainder."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % folds == fold


def plain_bytes(text: str) -> bytes:
    """Lower-cased letters in UTF-8, words parted by single spaces."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_KEPT).split())


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text or ""))


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of each state, the first state first: a path from it spells a substring, and every substring has one path."""
    nexts: list[dict[int, int]] = [{}]
    links, lengths = [-1], [0]
    last = 0
    for symbol in symbols:
        new = len(nexts)
        nexts.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        state = last
        while state != -1 and symbol not in nexts[state]:
            nexts[state][symbol] = new
            state = links[state]
        if state != -1:
            target = nexts[state][symbol]
            if lengths[target] == lengths[state] + 1:
                links[new] = target
            else:
                # the target also ends longer substrings; its shorter ones get a state of their own
                split = len(nexts)
                nexts.append(dict(nexts[target]))
                links.append(links[target])
                lengths.append(lengths[state] + 1)
                links[target] = links[new] = split
                while state != -1 and nexts[state].get(symbol) == target:
                    nexts[state][symbol] = split
                    state = links[state]
        last = new
    return nexts


class CrossParser:
    """Phrase counts of byte sequences against a sample for each language, by one table of all automata.

    The entry of a state and a symbol is the place of the next state's row, doubled, plus one if the symbol begins a phrase.
    """

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        self.bits = np.array([math.log2(max(2, sum(map(len, samples[k])))) for k in self.languages])
        self.classes = np.zeros((256, len(self.languages)), np.int64)
        tables, self.first, size = [], np.zeros(len(self.languages), np.int64), 0
        for at, language in enumerate(self.languages):
            # phrases do not cross pieces: byte 0 parts them and occurs in no text
            nexts = suffix_automaton(b"\0".join(samples[language]))
            known = sorted({symbol for some in samples[language] for symbol in some})
            self.classes[known, at] = np.arange(1, len(known) + 1)  # class 0: no place of the sample has it
            width = len(known) + 1
            edges = [(state, symbol, target) for state, out in enumerate(nexts) for symbol, target in out.items() if symbol]
            table = np.full((len(nexts), width), -1, np.int64)
            if edges:
                state, symbol, target = np.array(edges).T
                table[state, self.classes[symbol, at]] = target
            begun = (table == -1) | (np.arange(len(nexts)) == 0)[:, None]
            anew = np.maximum(table[0], 0)  # a symbol without a match leaves the next one to begin anew
            table = np.where(table == -1, anew[None, :], table)
            tables.append(((size + table * width) * 2 + begun).astype(np.int32).ravel())
            self.first[at] = size
            size += table.size
        self.table = np.concatenate(tables) if tables else np.empty(0, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: the number of phrases in each language."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        if not len(owner):
            return out
        symbols = np.frombuffer(b"".join(texts), np.uint8)
        within = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + within
        length = np.minimum(BLOCK, np.repeat(sizes, blocks) - within)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        rows = np.tile(self.first, (len(owner), 1))
        count = np.zeros(rows.shape, np.int32)
        # blocks that are still being parsed at each step, longest first
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
        for step, n in enumerate(active):
            entry = self.table[rows[:n] + self.classes[symbols[start[:n] + step]]]
            count[:n] += entry & 1
            rows[:n] = entry >> 1
        np.add.at(out, owner, count)
        return out

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        plain = [plain_bytes(t) if t and has_letter(t) else b"" for t in texts]
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if self.languages:
            bits = self.phrases(plain) * self.bits
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(-1000, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
            found = [(self.languages[b], float(s)) if p else known for p, b, s, known in zip(plain, best, share, found, strict=True)]
        return found


_parsers: dict[int, CrossParser] = {}


def _parser(samples: dict[str, list[bytes]]) -> CrossParser:
    """One parser for each model and Python worker."""
    key = hash(tuple((k, *v) for k, v in sorted(samples.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", pieces: int = PIECES, chars: int = PIECE_CHARS) -> dict[str, list[bytes]]:
    """Samples of each language of ``docs``: pieces of the distinct texts with the least hashes, each from a place that its hash names.

    Rows with a null language or text, and texts without a letter, teach nothing. A language's sample has ``pieces`` pieces of ``chars`` characters at
    most, and fewer if all languages' samples would have more than ``SAMPLE_CHARS``; so what the driver gets is bounded as languages are. The
    same rows give the same samples in any order.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("text"))
    # copies count once
    hashes = materialize(rows.select("lang", "hash").distinct(), "hashes")
    languages = hashes.agg(F.count_distinct("lang")).first()[0]
    each = max(1, min(pieces, SAMPLE_CHARS // (chars * max(1, languages))))
    order = Window.partitionBy("lang").orderBy("hash")
    chosen = materialize(hashes.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).drop("r"), "chosen")
    start = F.pmod("hash", F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    # as many rows as pieces
    taken = rows.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min(F.substring("text", start, F.lit(chars))).alias("piece"))
    samples: dict[str, list[bytes]] = {}
    for row in taken.orderBy("lang", "hash").collect():
        if piece := plain_bytes(row["piece"]):
            samples.setdefault(row["lang"], []).append(piece)
    return samples


def identify_language(docs: DataFrame, samples: dict[str, list[bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score) of each row of ``docs``.

    ``lang_pred`` is the language whose sample parses the whole text with the fewest bits (ties: the least by code point), and ``score`` its share
    of the languages' probabilities 2^-bits: 1 over the number of languages at least, near 1 for all but short texts. A null text, one without a
    letter, and any text where no language was learnt, get ``und`` and score 0. Repeated rows are answered alike, texts may be of any length, and
    other columns are ignored. No rows give no rows.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([chosen.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    room = max(2**16, SLICE_BYTES // max(1, len(samples)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for batch in batches:
            found: list[tuple[str, float]] = []
            part: list[str | None] = []
            held = 0
            for value in batch.column("text"):
                part.append(value.as_py())
                held += len(part[-1] or "")
                if held >= room:
                    found += parser.identify(part)
                    part, held = [], 0
            found += parser.identify(part)
            arrays = [batch.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    with arrow_batches(docs.sparkSession, TEXTS_AT_ONCE):
        return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)
