"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern knows.

A candidate is a run of 20 or more characters of the usual encodings; shorter secrets are left to the fixed patterns. Its encoding is
inferred from its alphabet, and two nulls are tested. *Uniform*: a secret's symbols are drawn evenly and independently, so the
chi-squared statistic of symbol counts, the number of runs of symbol classes and the lag-1 serial correlation must not be
rejected. *Written*: names, paths and prose keep to a class of symbols, alternate vowels and consonants and favour some
letters; the likelihood of even symbols over that of written ones is large by chance with a probability of its inverse at most,
which is the p-value. It goes through a Benjamini-Hochberg procedure over the candidates of a document, weighted by
length, as a short string carries less evidence. All of it is reckoned in logarithms, so strings may be of any length.

``=`` within a run parts a name from its value, so each side is a candidate. A part that no alphabet covers mixes signs of base64
with those of base64url; it is cut at either's signs and at all but ``+``, and of overlapping cuts that pass the least p-value stays.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 24
KINDS = ("assign", "access", "hex", "random")

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A run that may hold access keys, hex strings or encoded random bytes.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RUN_LEAST = 20
#: Parts of a run between inner ``=``; those at its end are padding.
PART = re.compile(r"[^=]+(?:=+\Z)?")
#: What is left of a part that no alphabet covers: base64, base64url, or what stands between their separators.
CUTS = tuple(re.compile(p) for p in (r"[^_-]+", r"[^+/]+", r"[^/_-]+"))

# Alphabets by encoding, in symbol order.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_COVERED = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}
_SYMBOLS = {name: np.array([max(0, alphabet.find(chr(b))) for b in range(256)]) for name, alphabet in ENCODINGS.items()}

# Shares of letters in written English, by per mille.
LETTERS = {
    "a": 82, "b": 15, "c": 28, "d": 43, "e": 127, "f": 22, "g": 20, "h": 61, "i": 70, "j": 2, "k": 8, "l": 40, "m": 24,
    "n": 67, "o": 75, "p": 19, "q": 1, "r": 60, "s": 63, "t": 91, "u": 28, "v": 10, "w": 24, "x": 2, "y": 20, "z": 1,
}
#: Least share of a letter, as languages and names differ.
LEAST_LETTER = 8
#: Classes of symbols in written strings: digits, upper and lower case, signs; their shares, and the chance that neighbours differ in class.
WRITTEN_CLASSES = (0.1, 0.15, 0.7, 0.05)
WRITTEN_CHANGE = 0.15
#: Chance of a vowel after a vowel, after a consonant, and after another symbol.
VOWEL_AFTER = (0.2, 0.55, 0.38)
UNIFORM_LEVEL = 1e-3
FALSE_DISCOVERIES = 1e-2


def _written_tables() -> tuple[np.ndarray, ...]:
    """By byte: its class, its kind (vowel, consonant, other), its log share in class and kind; by pairs of classes and of kinds: log chances."""
    classes, kinds, own = np.full(256, 3), np.full(256, 2), np.full(256, math.log(1 / 4))
    for c in map(chr, range(128)):
        if c.isdigit():
            classes[ord(c)], own[ord(c)] = 0, math.log(1 / 10)
        elif c.isalpha():
            vowel = c.lower() in "aeiou"
            alike = sum(max(v, LEAST_LETTER) for x, v in LETTERS.items() if (x in "aeiou") == vowel)
            classes[ord(c)], kinds[ord(c)] = 1 if c.isupper() else 2, 0 if vowel else 1
            own[ord(c)] = math.log(max(LETTERS[c.lower()], LEAST_LETTER) / alike)
    share = np.array(WRITTEN_CLASSES)
    change = np.log(WRITTEN_CHANGE * share[None, :] / (1 - share[:, None]))
    np.fill_diagonal(change, math.log(1 - WRITTEN_CHANGE))
    letters = np.array([[math.log(v), math.log(1 - v), 0.0] for v in VOWEL_AFTER])
    return classes, kinds, own, change, letters


_CLASSES, _KINDS, _OWN, _CHANGE, _LETTERS = _written_tables()


def written_log(body: str) -> float:
    """Log likelihood of a string of ASCII as a written one."""
    codes = np.frombuffer(body.encode("ascii"), dtype=np.uint8)
    classes, kinds = _CLASSES[codes], _KINDS[codes]
    before = np.concatenate(([2], kinds[:-1]))
    return math.log(WRITTEN_CLASSES[classes[0]]) + float(_CHANGE[classes[:-1], classes[1:]].sum() + _LETTERS[before, kinds].sum() + _OWN[codes].sum())


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer_encoding(run: str) -> str | None:
    """The smallest encoding whose alphabet covers the run, padding aside."""
    body = set(run.rstrip("="))
    return next((name for name, covered in _COVERED.items() if body and body <= covered), None)


def randomness(run: str) -> tuple[float, float] | None:
    """(least p-value under the uniform null, log p-value under the written null); None if no encoding fits."""
    name = infer_encoding(run)
    if name is None:
        return None
    body = run.rstrip("=")
    codes = np.frombuffer(body.encode("ascii"), dtype=np.uint8)
    symbols = _SYMBOLS[name][codes]
    n, size = len(symbols), len(ENCODINGS[name])
    counts = np.bincount(symbols, minlength=size)
    # chi-squared of counts against even ones, with its exact mean and variance
    chi = (counts.astype(float) ** 2).sum() * size / n - n
    spread = math.sqrt(max(1e-9, 2 * (size - 1) * (n - 1) / n))
    p_chi = _normal_tail((chi - (size - 1)) / spread)
    classes = _CLASSES[codes]
    changes = int((classes[1:] != classes[:-1]).sum())
    share = np.bincount(_CLASSES[np.frombuffer(ENCODINGS[name].encode("ascii"), dtype=np.uint8)], minlength=4) / size
    even = 1 - float((share**2).sum())
    dev = math.sqrt(max(1e-9, (n - 1) * even * (1 - even) * 1.5))
    p_runs = 2 * _normal_tail(abs(changes - (n - 1) * even) / dev)
    centred = symbols - symbols.mean()
    power = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p_serial = 2 * _normal_tail(abs(serial + 1 / n) * math.sqrt(n))
    # the encoding is one of several that might have been inferred
    return min(p_chi, p_runs, p_serial), min(0.0, math.log(len(ENCODINGS)) + written_log(body) + n * math.log(size))


def discoveries(log_p: list[float], lengths: list[int], level: float = FALSE_DISCOVERIES) -> list[bool]:
    """Weighted Benjamini-Hochberg on log p-values: weights in proportion to length, 1 on average."""
    if not log_p:
        return []
    scaled = np.array(log_p) - np.log(np.array(lengths, dtype=float) / np.mean(lengths))
    order = np.argsort(scaled, kind="stable")
    passed = np.flatnonzero(scaled[order] <= np.log(level * np.arange(1, len(order) + 1) / len(order)))
    chosen = np.zeros(len(order), dtype=bool)
    if len(passed):
        chosen[order[: passed[-1] + 1]] = True
    return chosen.tolist()


def candidates(run: str) -> list[tuple[int, int]]:
    """(start, end) of the strings of a run that may be encoded: its parts between ``=``, and the cuts of those that no alphabet covers."""
    found = set()
    for m in PART.finditer(run):
        if m.end() - m.start() < RUN_LEAST:
            continue
        if infer_encoding(m[0]):
            found.add(m.span())
        else:
            found |= {(m.start() + x.start(), m.start() + x.end()) for cut in CUTS for x in cut.finditer(m[0]) if len(x[0]) >= RUN_LEAST}
    return sorted(found)


def apart(spans: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of those (log p-value, start, end) that overlap none of a lesser p-value; ties go to the longer one."""
    chosen: list[tuple[int, int]] = []
    for _, start, end in sorted(spans, key=lambda s: (s[0], s[1] - s[2], s[1])):
        at = bisect.bisect(chosen, (start, end))
        if (at == 0 or chosen[at - 1][1] <= start) and (at == len(chosen) or end <= chosen[at][0]):
            chosen.insert(at, (start, end))
    return chosen


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text, in code points, by start, then kind.

    Base kinds are the leftmost non-overlapping matches of their pattern that are long enough. A random run is added
    only where no base span overlaps it.
    """
    spans = []
    low = text.lower()
    if any(word in low for word in KEYWORDS) or len(low) != len(text):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    runs = []
    for m in RUN.finditer(text):
        run, at = m[0], m.start()
        if "AKIA" in run:
            spans += [("access", at + x.start(), at + x.end()) for x in ACCESS.finditer(run) if len(x[0]) >= ACCESS_LEAST]
        spans += [("hex", at + x.start(), at + x.end()) for x in HEX.finditer(run) if len(x[0]) >= HEX_LEAST]
        runs += [(at + a, at + b, run[a:b]) for a, b in candidates(run)]
    if runs:
        tested = []
        for start, end, run in runs:
            if not any(s < end and start < e for _, s, e in spans) and (found := randomness(run)):
                tested.append((start, end, *found))
        passed = discoveries([t[3] for t in tested], [t[1] - t[0] for t in tested])
        spans += [("random", a, b) for a, b in apart([(t[3], t[0], t[1]) for t, ok in zip(tested, passed, strict=True) if ok and t[2] >= UNIFORM_LEVEL])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and spans, an array of (kind, start, end, value), for each row of ``docs``; empty if there is none.

    A null text counts as empty; whole texts are scanned, one at a time. Offsets count code points, ``end`` is exclusive. Repeated rows
    and null ids are kept; other columns are ignored. No rows give no rows.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("start", "end")), T.StructField("value", T.StringType())]))
    schema = T.StructType([chosen.schema["id"], T.StructField("spans", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    found.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in scan(text)])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, kind)], names=["id", "spans"])

    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)
