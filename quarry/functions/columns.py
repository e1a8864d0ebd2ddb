"""Column expressions that several operators share. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_category(name: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """The group that lists the name, else the name itself; null stays null."""
    out = None
    for group, members in groups.items():
        hit = name.isin(*members)
        out = F.when(hit, F.lit(group)) if out is None else out.when(hit, F.lit(group))
    return name if out is None else out.otherwise(name)


def label_to_phase(label: Column, prefix: str = "P") -> Column:
    """``P<int>`` labels as zero-based phases: every prefix character goes, the rest is cast, less 1. A bad label is an error."""
    return F.replace(label, F.lit(prefix), F.lit("")).cast("int") - 1


def version_filter(batch: Column, version: Column, suffix: str = "XX", suffixed: int = 3, plain: int = 1) -> Column:
    """Batches that end in ``suffix`` need one version, all others another; a null batch never passes.

    The redundant list of versions is what a Parquet scan can filter on.
    """
    tail = F.right(batch, F.lit(len(suffix)))
    return version.isin(suffixed, plain) & (((tail == suffix) & (version == suffixed)) | ((tail != suffix) & (version == plain)))


def difference(a: Column, b: Column) -> Column:
    """a - b, null as 0."""
    return F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))


def snap_difference(a: Column, b: Column, tolerance: str = "1e-9") -> Column:
    """a - b, null as 0, and 0 below the tolerance in absolute value. The tolerance is an exact decimal."""
    d = difference(a, b)
    return F.when(F.abs(d) < F.expr(f"{tolerance}BD"), F.lit(0)).otherwise(d)


def rounded_difference(a: Column, b: Column, digits: int = 9) -> Column:
    """a - b, null as 0, rounded half away from zero."""
    return F.round(difference(a, b), digits)


def hex_to_bits(text: Column) -> Column:
    """A hex string as a string of bits, four for each digit, leading zeros kept; null for text that is not hex."""
    digits = F.transform(F.split(text, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0"))
    return F.when(text.rlike("^[0-9A-Fa-f]*$"), F.array_join(digits, ""))


def bits_to_hex(bits: Column) -> Column:
    """A string of bits as lower-case hex digits; a length that is no multiple of four is padded with zeros on the left."""
    width = (F.length(bits) + 3).cast("int")
    padded = F.lpad(bits, (width - width % 4), F.lit("0"))
    groups = F.regexp_extract_all(padded, F.lit("[01]{4}"), 0)
    return F.lower(F.array_join(F.transform(groups, lambda g: F.conv(g, 2, 16)), ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null for a zero vector, a null, or unlike lengths."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)
