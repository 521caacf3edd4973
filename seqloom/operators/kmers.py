"""K-mers as numbers, two bits a base (A 0, C 1, G 2, T 3), cut from texts by whole arrays.

A k-mer of up to 31 bases is a number that sorts as its text does. Texts come in pieces of bounded length that hold
the k - 1 bases after them, so each k-mer lies in one piece. Both strands are read from the forward text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import clean, normal, pieces

PIECE = 65_536
#: Bases looked at in one go, and k-mers that are counted before they are sent on.
BLOCK, COUNTED = 1 << 20, 1 << 22
#: Groups that counted k-mers are dealt to by a hash (a power of two), and bits of the bitmap of wanted k-mers (4 MB).
GROUPS, BITS = 10, 25
#: What a byte stands for; 4 is no base.
DIGIT = np.full(256, 4, dtype=np.uint64)
DIGIT[[*b"ACGT"]] = np.arange(4)
MIX = np.uint64(0x9E3779B97F4A7C15)


def texts(seqs: DataFrame, k: int) -> DataFrame:
    """(rid, len, start, bases): ``seqs(rid, seq)`` in pieces, ambiguous bases as A."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("seq").alias("own"), F.col("seq").alias("bases")))
    parts = F.when(F.length("seq") <= PIECE, whole).otherwise(pieces(F.col("seq"), PIECE, k - 1))
    cleaned = seqs.select("rid", clean(F.col("seq")).alias("seq"))
    return cleaned.select("rid", F.length("seq").cast("long").alias("len"), F.explode(parts).alias("p")).select("rid", "len", "p.start", "p.bases")


def windows(digits: np.ndarray, k: int, back: bool) -> np.ndarray:
    """The number of the k-mer at each place of ``digits``; with ``back`` that of its reverse complement."""
    n, out, have = len(digits) - k + 1, None, 0
    part, size = (3 - digits if back else digits), 1
    while size <= k:
        if k & size:
            piece = part[have : have + n]
            out = piece.copy() if out is None else (out | piece << np.uint64(2 * have)) if back else (out << np.uint64(2 * size) | piece)
            have += size
        if 2 * size <= k:
            low, high = part[: len(part) - size], part[size:]
            part = (low | high << np.uint64(2 * size)) if back else (low << np.uint64(2 * size) | high)
        size *= 2
    return out


def blocks(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, digits at it and after it) of a column of texts, some rows at a time: the places where a k-mer begins."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        size = np.diff(offsets[at : to + 1])
        n = np.maximum(size - k + 1, 0)
        row = np.repeat(np.arange(at, to), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if len(row):
            yield row, place + offsets[row] - offsets[at], DIGIT[data[offsets[at] : offsets[to]]]
        at = to


def spelled(codes: np.ndarray, k: int) -> pa.Array:
    """Numbers as text."""
    shift = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)
    letters = np.frombuffer(b"ACGT", dtype=np.uint8)[(codes[:, None] >> shift & np.uint64(3)).astype(np.uint8)]
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(np.arange(0, k * len(codes) + 1, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters))])


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    firsts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[firsts], np.add.reduceat(n[order], firsts)


def counts(seqs: DataFrame, k: int = 14) -> DataFrame:
    """(kmer, occ): the k-mers of ``seqs(rid, seq)`` on both strands.

    A k-mer and its reverse complement have as many places, so the smaller number of both is counted. Tasks count what they
    see and send packed numbers to groups by a hash; no group sees a k-mer more often than there are blocks.
    """
    small = np.dtype("<u4" if k <= 16 else "<u8")

    def pack(codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(codes), return_counts=True)
        group = (found.astype(np.uint64) * MIX >> np.uint64(64 - GROUPS)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=1 << GROUPS))
        found, n = found[order], n[order].astype("<u4")
        spans = [(g, b, e) for g, (b, e) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)) if e > b]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in spans], pa.int32()), pa.array([found[b:e].tobytes() for _, b, e in spans], pa.binary()), pa.array([n[b:e].tobytes() for _, b, e in spans], pa.binary())], names=["grp", "codes", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, most = [], 0
        for batch in batches:
            for _, at, digits in blocks(batch.column(0), k):
                held.append(np.minimum(windows(digits, k, False)[at], windows(digits, k, True)[at]).astype(small))
                most += len(held[-1])
                if most >= COUNTED:
                    yield from pack(held)
                    held, most = [], 0
        if most:
            yield from pack(held)

    def merge(block: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(block.column("codes").to_pylist()), dtype=small)
        n = np.frombuffer(b"".join(block.column("n").to_pylist()), dtype="<u4").astype(np.int64)
        codes, n = summed(codes, n)
        codes = codes.astype(np.uint64)
        back = mirrored(codes, k)
        other = codes != back
        return pa.table({"kmer": spelled(np.concatenate([codes, back[other]]), k), "occ": pa.array(np.concatenate([np.where(other, n, 2 * n), n[other]]))})

    packed = texts(seqs, k).select("bases").mapInArrow(cut, "grp int, codes binary, n binary")
    return packed.groupBy("grp").applyInArrow(merge, "kmer string, occ bigint")


def mirrored(codes: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of numbers."""
    out, left = np.zeros_like(codes), codes.copy()
    for _ in range(k):
        out = out << np.uint64(2) | (np.uint64(3) - (left & np.uint64(3)))
        left >>= np.uint64(2)
    return out


def bits(codes: np.ndarray) -> np.ndarray:
    return (codes * MIX >> np.uint64(64 - BITS)).astype(np.int64)


def wanted(reads: DataFrame, k: int = 14) -> np.ndarray:
    """A bitmap of hashes of the k-mers of ``reads(seq)``, ``BITS`` for any number of reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, digits in blocks(batch.column(0), k):
                bad = np.cumsum(np.append(0, digits == 4))
                at = at[bad[at + k] == bad[at]]
                bit = np.unique(bits(windows(digits & np.uint64(3), k, False)[at]))
                yield pa.RecordBatch.from_arrays([pa.array(bit >> 5), pa.array(1 << (bit & 31))], names=["word", "mask"])

    texts_ = reads.where("seq IS NOT NULL").select(normal(F.col("seq")).alias("seq"))
    rows = texts_.mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (BITS - 5), dtype=np.uint32)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return out


def places(pieces_: DataFrame, bitmap: np.ndarray, k: int = 14) -> DataFrame:
    """(kmer, rid, strand, pos): places of the k-mers that ``bitmap`` lets through, all that are wanted and few others.

    ``pieces_`` is (rid, len, start, bases), for both strands, or (rid, strand, start, bases), for its own.
    """
    both = "strand" not in pieces_.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, start, more = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            for row, at, digits in blocks(batch.column(3), k):
                first = np.searchsorted(row, row)  # the first place of a row is its offset
                for strand in (0, 1) if both else (0,):
                    codes = windows(digits, k, bool(strand))[at]
                    bit = bits(codes)
                    ok = np.flatnonzero(bitmap[bit >> 5] >> (bit & 31).astype(np.uint32) & 1)
                    if len(ok):
                        r = row[ok]
                        pos = start[r] + at[ok] - at[first[ok]]
                        side = np.full(len(ok), strand) if both else more[r]
                        yield pa.RecordBatch.from_arrays([spelled(codes[ok], k), pa.array(rid[r].astype(np.int64)), pa.array(side.astype(np.int32)), pa.array((more[r] - pos - k if strand else pos).astype(np.int64))], names=["kmer", "rid", "strand", "pos"])

    return pieces_.select("rid", "start", "len" if both else "strand", "bases").where("bases IS NOT NULL").mapInArrow(run, "kmer string, rid bigint, strand int, pos bigint")
