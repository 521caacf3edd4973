"""Column functions over sequences of the letters A, C, G, T; anything else is ambiguous."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project(text: Column) -> Column:
    """Text as a sequence: its letters, mapped onto four bases (Q and Z onto N)."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTNCGTACGTAN")


def clean(seq: Column) -> Column:
    """Upper case, every ambiguous base as A."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "A")


def normal(seq: Column) -> Column:
    """Upper case, every ambiguous base as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def is_ambiguous(seq: Column) -> Column:
    return F.coalesce(seq.rlike("[^ACGTacgt]"), F.lit(False))


def trim_mate(name: Column) -> Column:
    """A read name without a closing /1 or /2."""
    return F.when(F.length(name) > 2, F.regexp_replace(name, "/[0-9]$", "")).otherwise(name)


def pair_codes(seq: Column, phase: int) -> Column:
    """Pairs of bases from ``phase`` on, each as one of 16 digits; a single last base is left out."""
    base = lambda i: F.instr(F.lit("ACGT"), F.substr(seq, i, F.lit(1))) - 1
    at = F.sequence(F.lit(0), F.floor((F.length(seq) - phase) / 2).cast("int") - 1)
    code = F.transform(at, lambda i: F.substr(F.lit("0123456789ABCDEF"), 4 * base(2 * i + phase + 1) + base(2 * i + phase + 2) + 1, F.lit(1)))
    return F.when(F.length(seq) >= phase + 2, F.array_join(code, "")).otherwise(F.lit(""))


def pieces(seq: Column, size: int, overlap: int) -> Column:
    """``seq`` cut once from left to right: an array of (start, own bases, bases with ``overlap`` more)."""
    parts = F.regexp_extract_all(seq, F.lit(f".{{1,{size}}}"), F.lit(0))
    return F.transform(parts, lambda x, i: F.struct((i * size).cast("long").alias("start"), F.length(x).alias("own"), F.concat(x, F.substring(F.coalesce(F.get(parts, i + 1), F.lit("")), 1, overlap)).alias("bases")))
