"""Words and shingles of many texts at once, as NumPy works on the buffer of an Arrow column.

A word's hash is a polynomial over its bytes, modulo 2**64, taken from prefix sums: with an odd base the
powers have inverses, so the hash of any stretch is a difference of two prefix sums times one power. The
bytes are first replaced by random 64-bit numbers, and the results are mixed, so that the known weak
cases of this modulus do not show.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Seed of the random numbers that stand for bytes and positions.
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of which prefix sums are taken at once.
STEP = 1 << 18
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n``; kept and doubled as needed."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.ones(size, dtype=np.uint64)
        step, have = np.uint64(base), 1
        with np.errstate(over="ignore"):
            while have < size:
                out[have : 2 * have] = out[:have] * step
                step, have = step * step, 2 * have
        known = _powers[base] = out
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins and ends in them; null rows are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and the first word of each row (one more entry at the end)."""
    text = ~_SPACE[data]
    before = np.empty(len(text), dtype=bool)
    before[:1] = False
    before[1:] = text[:-1]
    edges = rows[1:-1]
    edges = edges[edges < len(text)]
    opens = text & ~before
    opens[edges] |= text[edges]  # a row's first byte never continues the row before it
    starts = np.flatnonzero(opens)
    closes = np.empty(len(text), dtype=bool)
    closes[:-1] = text[:-1] & (~text[1:] | opens[1:])
    closes[-1:] = text[-1:]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, rows)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of every word; with ``lower``, A to Z count as a to z."""
    out, numbers, i = np.empty(len(starts), dtype=np.uint64), _LOWER if lower else _BYTES, 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            first = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, first + STEP, side="right")))
            part = data[first : ends[j - 1]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(numbers[part] * powers(_INVERSE, len(part))[: len(part)], out=sums[1:])
            at, to = starts[i:j] - first, ends[i:j] - first
            out[i:j] = mix((sums[to] - sums[at]) * powers(_BASE, len(part) + 1)[at] + (to - at).astype(np.uint64) * _BYTES[0])
            i = j
    return out


def hash_runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` hashes, wherever it begins; shorter tails are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * np.uint64(_BASE) + hashes[i : i + n]
    return mix(out)


def give_back() -> None:
    """Returns memory that this worker has freed to the system: later stages use the same workers, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``most`` bytes of a string column; a longer row stands alone."""
    held, size = [], 0
    for batch in batches:
        at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            before = at[i - 1] if i else 0
            j = min(batch.num_rows, max(i + 1, int(np.searchsorted(at, before + most - size, side="right"))))
            held.append(batch.slice(i, j - i))
            size += int(at[j - 1] - before)
            i = j
            if size >= most or i < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)
    give_back()


def binary_column(parts: list[np.ndarray]) -> pa.Array:
    """A column of the bytes of ``parts``."""
    return pa.array([x.tobytes() for x in parts], pa.binary())


def split_rows(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column: rows ``bounds[i]`` to ``bounds[i + 1]`` of a two-dimensional array as one value each."""
    width = data.dtype.itemsize * data.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays in one value: their lengths, then their bytes."""
    return np.array([len(x) for x in arrays], dtype="<i8").tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)


def unblob(value: bytes, kinds: list[str]) -> list[np.ndarray]:
    lengths = np.frombuffer(value, dtype="<i8", count=len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(lengths, kinds, strict=True):
        out.append(np.frombuffer(value, dtype=kind, count=n, offset=at))
        at += int(n) * np.dtype(kind).itemsize
    return out
