"""Exact Jaccard self-join of n-gram sets, by universe partitions and the pigeonhole principle.

Sets of like size share a band, and each band has a hash that cuts the universe of shingles into segments.
Two sets of sizes l <= s with Jaccard similarity t or more differ in at most ``H = (1-t)/(1+t) * (l+s)``
shingles, so of ``H + 1`` segments in which either has something, one must be equal in both. A set therefore
indexes its subsets in its first ``H + 1`` non-empty segments, in an order that all sets of the band share.
(Say X's list ends first. Each segment on it in which Y differs holds one of at most H differences; so X
and Y agree in one of them, and Y, whose list reaches further, indexes it too.)

A segment counts double if also its one-deletion neighbourhood is indexed, the subsets that lack one element:
then only two differences hide it. The order is by cost: all first and second units of segments are
ranked by the candidates they are expected to make, which is measured over all documents (a sketch of the
squared frequencies of each segment's subsets), plus the index entries they need. So a segment that holds part
of a passage shared by many documents is used last, after the neighbourhoods of quiet segments.

Equal sets are one node. Index blocks, dealt by hash, give lists of nodes with a common entry. In each list
a leading node is compared with all others, and what is verified joins components; this is linear in a list's size, and
all there is to do for a list of two. Longer lists that then still hold several components are merged where they have much the same
nodes, and closed by parity sketches: a set's shingles are hashed to bits, two to
four for each of them, and each flips its bit. Sketches of two sets differ in no more bits than the sets differ in shingles, and
in little fewer, so nearly all pairs that are too far apart are ruled out for certain, in the block of the list that
holds them. A round gives only the nearest open partners of each member, and only lists that had more go on to the next,
which gives more of them; so what large groups of near copies have in common is joined by few links a node and
never paired off. In the end every pair of a list is in one component, ruled out, or compared.

A list whose sketches exceed a block is dealt over several: members of its largest component are not compared among
themselves, all others meet every block. Pairs are verified on whole texts; shingles compare by 64-bit hashes.

Defined results: null, empty and wordless texts have empty sets, and reach only themselves; rows with a
null id keep their size, have no component and link nothing; of rows of equal id each has its own set, and rows that repeat
are one node; texts are read whole however long they are; other columns take no part, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import among, bound_batches, cut, forget, partitions, table
from .components import components

SHINGLE, PERCENT = 5, 80
#: Rounds in which lists are compared with one leader, before what is left open is closed.
STARS = 2
#: Members of a block of an open list, and bytes of their sketches.
SIDE, SIDE_BYTES = 2048, 8_000_000
#: Open partners that a member gives in the first round that closes lists; each round gives as many times more.
NEAREST = 16
#: Bands whose segments are measured: sets up to 65,535 shingles. Longer ones take their segments as they come.
MEASURED = 16
CHUNK = 2_000_000
#: Counters of the sketch that measures a segment's cost.
SLOTS = 16
#: Bits of an index entry's key that are sent beside its part, and bytes of an entry with the bit before them. Entries that differ
#: only in what isn't sent share a list: that makes candidates, and no link.
KEY_BITS, ENTRY_BYTES = 39, 5
_SALT = np.uint64(0xD1B54A32D192ED03)


def band_of(sizes: np.ndarray) -> np.ndarray:
    """Band b holds sizes from 2**b to 2**(b + 1) - 1."""
    return np.frexp(sizes.astype(np.float64))[1] - 1


def largest(band):
    return (1 << (band + 1)) - 1


def segments(band: int, percent: int) -> int:
    """Enough for most sets to have more non-empty ones than they need; next to one shingle each if sets are small."""
    hi = largest(band)
    return 64 * hi if hi < 64 else -(-hi * max(100, 140 * 3 * (100 - percent) // percent) // 300)


@dataclass
class Sets:
    """Distinct shingles of many rows: ``shingles[first[i]:first[i + 1]]``, sorted, are those of row i."""

    shingles: np.ndarray
    first: np.ndarray
    sizes: np.ndarray = field(init=False)

    def __post_init__(self):
        self.sizes = np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def nodes(self) -> np.ndarray:
        """One number for a set; the empty set has 0."""
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(B.mix(self.shingles ^ _SALT), dtype=np.uint64)])
            out = B.mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.sizes.astype(np.uint64) * _SALT)
        return np.where(self.sizes > 0, out, 0).astype(np.uint64).view(np.int64)

    def sketches(self) -> pa.Array:
        """Parities of the shingles that fall on each bit, in half as many bytes as a set's band has shingles at least, or in as many if they are eight or fewer."""
        least = 1 << np.maximum(band_of(np.maximum(self.sizes, 1)), 0)
        widths = np.where(self.sizes > 0, np.maximum(least // 2, np.minimum(least, 8)), 0)
        begin = np.concatenate([[0], np.cumsum(widths)])
        row = self.rows()
        at = begin[:-1][row] * 8 + (B.mix(self.shingles) & (8 * widths[row] - 1).astype(np.uint64)).astype(np.int64)
        bits = np.packbits((np.bincount(at, minlength=8 * begin[-1]) & 1).astype(np.uint8), bitorder="little")
        return pa.Array.from_buffers(pa.large_binary(), len(widths), [None, pa.py_buffer(begin.astype(np.int64).tobytes()), pa.py_buffer(bits.tobytes())]).cast(pa.binary())

    def take(self, rows: np.ndarray) -> Sets:
        sizes = self.sizes[rows]
        first = np.concatenate([[0], np.cumsum(sizes)])
        return Sets(self.shingles[np.repeat(self.first[:-1][rows] - first[:-1], sizes) + np.arange(first[-1])], first)


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Sets:
    """The sets of a string column; words are lower-cased in A to Z, and a shorter text is one shingle."""
    data, rows = B.column_bytes(column)
    starts, ends, first = B.words(data, rows)
    hashes = B.hash_words(data, starts, ends, lower=True)
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(n)), counts)
    at = first[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    out = np.zeros(begin[-1], dtype=np.uint64)
    for k in range(1, width + 1):
        mine = np.minimum(n, width)[row] == k
        if mine.any():
            out[mine] = B.hash_runs(hashes, k)[at[mine]] ^ np.uint64(int(_SALT) * (width - k) % 2**64)
    for i, j in zip(begin[:-1], begin[1:], strict=True):
        if j - i > 1:
            out[i:j].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return Sets(out[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))]))


def schemes(sets: Sets, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, rows that index by its segments, units each needs): own band, and the one below if a partner may be there."""
    filled = np.flatnonzero(sets.sizes)
    sizes = sets.sizes[filled]
    bands = band_of(sizes)
    for band in np.unique(bands).tolist():
        own = bands == band
        yield band, filled[own], (100 - percent) * sizes[own] // percent + 1
        hi = largest(band - 1)
        low = own & (sizes * percent <= 100 * hi)
        if band and low.any():
            yield band - 1, filled[low], (100 - percent) * (sizes[low] + hi) // (100 + percent) + 1


@dataclass
class Subsets:
    """Non-empty segments of some sets in one band: row, segment, size, sum of mixed shingles; and the shingles by segment."""

    row: np.ndarray
    segment: np.ndarray
    size: np.ndarray
    total: np.ndarray
    begin: np.ndarray
    mixed: np.ndarray


def subsets(sets: Sets, rows: np.ndarray, band: int, percent: int) -> Subsets:
    part, count = sets.take(rows), segments(band, percent)
    with np.errstate(over="ignore"):
        segment = ((B.mix(part.shingles + np.uint64(band + 1) * _SALT) >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part.rows() * count + segment, kind="stable")
        row, segment, mixed = part.rows()[order], segment[order], B.mix(part.shingles[order] + _SALT)
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])
        begin = np.flatnonzero(new)
        return Subsets(row[begin], segment[begin], np.diff(begin, append=len(row)), np.add.reduceat(mixed, begin) if len(begin) else mixed, begin, mixed)


def entry(band: int, segment: np.ndarray, total: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return B.mix(total + B.mix(np.uint64(band) << np.uint64(48) | segment.astype(np.uint64)))


def costs(sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters of the subsets in each segment: keys (band, segment, slot in one number) and counts."""
    keys = []
    for band, rows, _ in schemes(sets, percent):
        if band >= MEASURED:
            continue
        s = subsets(sets, rows, band, percent)
        slot = (entry(band, s.segment, s.total) >> np.uint64(60)).astype(np.int64)
        keys.append((band << 40 | s.segment) << 4 | slot)
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def ranks(measured: dict[int, dict[int, tuple[float, float]]], percent: int) -> dict[int, np.ndarray]:
    """Band -> the rank of each segment's first unit, then of each second one, from (squares, number) of each segment.

    Expected candidates of a set in a segment: the estimate of the sum of squared frequencies, over the number of sets.
    """
    out = {}
    for band, found in measured.items():
        n = segments(band, percent)
        squares, number = np.zeros(n), np.zeros(n)
        for segment, (square, total) in found.items():
            squares[segment], number[segment] = square, total
        made = np.maximum(0, squares - number**2 / SLOTS) * SLOTS / (SLOTS - 1) / np.maximum(number, 1)
        made = np.where(number**2 > 16 * SLOTS, made, 0)
        made = np.where(made > 3 * (1 + np.sqrt(2 * number / SLOTS) / 16), made, 0)  # within the sketch's error of a quiet segment
        cost = np.concatenate([made, made + 4])  # a neighbourhood has three more entries or so
        rank = np.empty(2 * n, dtype=np.int64)
        rank[np.argsort(cost, kind="stable")] = np.arange(2 * n)
        out[band] = rank
    return out


def entries(sets: Sets, order: dict[int, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of the sets: (key, row)."""
    keys, rows = [], []
    for band, chosen, need in schemes(sets, percent):
        s, n = subsets(sets, chosen, band, percent), segments(band, percent)
        rank = order.get(band)
        if rank is None:
            rank = np.arange(2 * n)
        two = np.flatnonzero(s.size > 1)
        unit = np.concatenate([np.arange(len(s.row)), two])
        by = np.concatenate([rank[s.segment], rank[n + s.segment[two]]])
        sorted_ = np.argsort(s.row[unit] * (2 * n) + by, kind="stable")
        row = s.row[unit[sorted_]]
        have = np.bincount(row, minlength=len(chosen))
        if (have < need).any():
            raise ValueError("a set has too few segments; another salt is needed")  # odds below those of equal 64-bit hashes
        nth = np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)
        picked = sorted_[nth < need[row]]
        plain, deleted = unit[picked[picked < len(s.row)]], unit[picked[picked >= len(s.row)]]
        keys.append(entry(band, s.segment[plain], s.total[plain]))
        rows.append(chosen[s.row[plain]])
        sizes = s.size[deleted]
        each = np.repeat(deleted, sizes)
        at = s.begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            keys.append(entry(band, s.segment[each], s.total[each] - s.mixed[at]))
        rows.append(chosen[s.row[each]])
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def dealt_entries(keys: np.ndarray, row: np.ndarray, nodes: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, entries): in each part a node's entries follow each other, and the first of them is marked, so that a node is named once."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(part * len(nodes) + row, kind="stable")
    part, row = part[by], row[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    codes = keys[by] & np.uint64((1 << KEY_BITS) - 1) | new.astype(np.uint64) << np.uint64(KEY_BITS)
    sent = codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ENTRY_BYTES]
    bounds = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        mine = slice(bounds[p], bounds[p + 1])
        yield p, B.blob(sent[mine].ravel(), nodes[row[mine][new[mine]]])


def met_entries(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key and node of every entry that was sent to a part."""
    got = [B.unblob(x, ["u1", "<i8"]) for x in values]
    codes = np.zeros((sum(len(g[0]) for g in got) // ENTRY_BYTES, 8), dtype=np.uint8)
    codes[:, :ENTRY_BYTES] = np.concatenate([g[0] for g in got]).reshape(-1, ENTRY_BYTES)
    codes = codes.view("<u8").ravel()
    nodes = np.concatenate([g[1] for g in got])
    return codes & np.uint64((1 << KEY_BITS) - 1), nodes[np.cumsum(codes >> np.uint64(KEY_BITS), dtype=np.int64) - 1]


def profiles(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """A row a document (what 0: doc_id, n, node, sketch, tag) and the counters of segments (what 1: doc_id is the key, n the count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("jaccard")
        names = ["what", "doc_id", "n", "node", "sketch", "tag"]
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in B.chunks(batches, 1, CHUNK):
            sets = shingle_sets(batch.column(1), width)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, dtype=np.int8)), batch.column(0), pa.array(sets.sizes), pa.array(sets.nodes()), sets.sketches(), batch.column(2)], names=names)
            new_keys, new_counts = costs(sets.take(np.unique(sets.nodes(), return_index=True)[1]), percent)
            keys, which = np.unique(np.concatenate([keys, new_keys]), return_inverse=True)
            counts = np.bincount(which, weights=np.concatenate([counts, new_counts]), minlength=len(keys)).astype(np.int64)
        n = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, dtype=np.int8)), pa.array(keys), pa.array(counts), pa.array(np.zeros(n, dtype=np.int64)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "what tinyint, doc_id bigint, n bigint, node bigint, sketch binary, tag bigint")


def measure(profile: DataFrame, percent: int) -> dict[int, np.ndarray]:
    """The order of units in each band; a row a segment comes to the driver: fewer than 100,000, as MEASURED bounds them."""
    slots = profile.where("what = 1").groupBy("doc_id").agg(F.sum("n").alias("n"))
    per = slots.groupBy(F.shiftright("doc_id", 44).alias("band"), (F.shiftright("doc_id", 4).bitwiseAND(F.lit((1 << 40) - 1))).alias("segment"))
    found: dict[int, dict[int, tuple[float, float]]] = {}
    for r in per.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.col("n").cast("double")).alias("number")).collect():
        found.setdefault(r["band"], {})[r["segment"]] = (r["squares"], r["number"])
    return ranks(found, percent)


def lists(docs: DataFrame, order: dict[int, np.ndarray], percent: int, width: int) -> DataFrame:
    """(list_id, node): nodes with a common index entry, two at least, each list once."""
    parts = 2 * partitions(docs.sparkSession)
    sent_order = docs.sparkSession.sparkContext.broadcast(order)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.chunks(batches, 1, CHUNK):
            sets = shingle_sets(batch.column(1), width)
            nodes, own = np.unique(sets.nodes(), return_index=True)
            own, nodes = own[nodes != 0], nodes[nodes != 0]
            keys, row = entries(sets.take(own), sent_order.value, percent)
            to = dict(dealt_entries(keys, row, nodes, parts))
            yield pa.RecordBatch.from_arrays([pa.array(list(to), pa.int32()), pa.array(list(to.values()), pa.binary())], names=["part", "value"])

    def gather(block: pa.Table) -> pa.Table:
        keys, nodes = met_entries([x.as_py() for x in block.column("value")])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        several = np.zeros(len(keys), dtype=bool)
        several[1:] = same
        several[:-1] |= same
        keys, nodes = keys[order[several]], nodes[order[several]]
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[new], nodes[new]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(begin, append=len(keys))
        if len(begin):
            with np.errstate(over="ignore"):
                ids = B.mix(np.add.reduceat(B.mix(nodes.view(np.uint64)), begin) + sizes.astype(np.uint64)).view(np.int64)
            ids, once = np.unique(ids, return_index=True)
            once = once[sizes[once] > 1]
        else:
            ids = once = begin
        begin, sizes = begin[once], sizes[once]
        ends = np.cumsum(sizes)
        at = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        with np.errstate(over="ignore"):
            ids = B.mix(np.add.reduceat(B.mix(nodes[at].view(np.uint64)), ends - sizes) + sizes.astype(np.uint64)).view(np.int64) if len(ends) else ids[:0]
        return pa.table({"list_id": np.repeat(ids.astype(np.int64), sizes), "node": nodes[at]})

    sent = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(send, "part int, value binary")
    return sent.groupBy("part").applyInArrow(gather, "list_id bigint, node bigint").distinct()


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) with fewer bits, as if they had been made so."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), sketches.shape[1] // width, width), axis=1)


def _apart(n_u: np.ndarray, n_v: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in so many shingles, or more, can't be similar."""
    return (differ * (100 + percent) > (100 - percent) * (n_u + n_v)) | (100 * np.minimum(n_u, n_v) < percent * np.maximum(n_u, n_v))


def _rows_by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bytes, the rows of a binary column that have so many, those as a matrix)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    whole, widths = np.frombuffer(data, dtype=np.uint8), np.diff(at)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield width, rows, whole[at[rows][:, None] + np.arange(width)] if len(rows) * width else np.zeros((len(rows), width), dtype=np.uint8)


def sketches_allow(n_u: np.ndarray, n_v: np.ndarray, x: pa.Array, y: pa.Array, percent: int) -> np.ndarray:
    """Which pairs of sets their sketches don't rule out."""
    ok = np.zeros(len(n_u), dtype=bool)
    right = list(_rows_by_width(y))
    for wide, rows, left in _rows_by_width(x):
        for other, others, matrix in right:
            both, i, j = np.intersect1d(rows, others, assume_unique=True, return_indices=True)
            width = min(wide, other)
            differ = np.bitwise_count(_folded(left[i], width) ^ _folded(matrix[j], width)).sum(axis=1, dtype=np.int64)
            ok[both] = ~_apart(n_u[both], n_v[both], differ, percent)
    return ok


def similar(left: Sets, right: Sets, percent: int) -> np.ndarray:
    """Whether row i of ``left`` is similar to row i of ``right``, exactly."""
    shingles = np.sort(np.concatenate([left.shingles, right.shingles]))
    shingles = shingles[np.append(True, shingles[1:] != shingles[:-1])[: len(shingles)]]
    place = lambda s: s.rows() * len(shingles) + np.searchsorted(shingles, s.shingles)
    common = np.bincount(left.rows()[np.isin(place(left), place(right), assume_unique=True)], minlength=len(left.sizes))
    return 100 * common >= percent * (left.sizes + right.sizes - common)


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """``pairs(u, v)`` of nodes -> those whose sets are similar; only texts that sketches leave in question are shuffled."""

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = sketches_allow(batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy(), batch.column("x"), batch.column("y"), percent)
                yield batch.filter(pa.array(ok)).select(["u", "v", "a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.chunks(B.chunks(iter([whole]), 3, CHUNK // 2), 2, CHUNK // 2):
                ids, where, which = np.unique(batch.column("u").to_numpy(), return_index=True, return_inverse=True)
                left, right = shingle_sets(batch.column("text_a").take(pa.array(where)), width).take(which), shingle_sets(batch.column("text_b"), width)
                ok = (left.nodes() == batch.column("u").to_numpy()) & (right.nodes() == batch.column("v").to_numpy()) & similar(left, right, percent)
                yield batch.filter(pa.array(ok)).select(["u", "v"])

    u = nodes.select(F.col("node").alias("u"), F.col("rep").alias("a"), F.col("n").alias("n_u"), F.col("sketch").alias("x"))
    v = nodes.select(F.col("node").alias("v"), F.col("rep").alias("b"), F.col("n").alias("n_v"), F.col("sketch").alias("y"))
    left = cut(pairs.join(u, "u").join(v, "v").select("u", "v", "a", "b", "n_u", "n_v", "x", "y").mapInArrow(rule_out, "u bigint, v bigint, a bigint, b bigint"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    text_b = among(known, "doc_id", left.select("b")).withColumnsRenamed({"doc_id": "b", "text": "text_b"})
    text_a = among(known, "doc_id", left.select("a")).withColumnsRenamed({"doc_id": "a", "text": "text_a"})
    return left.join(text_b, "b").join(text_a, "a").select("u", "v", "text_a", "text_b").mapInArrow(compare, "u bigint, v bigint")


def led(members: DataFrame) -> DataFrame:
    """(list_id, node, lists, component) -> pairs (u, v): the leader of each list, and each member of another component.

    The leader is the member of most lists outside the component that has most of them, or of all if
    each is a component of its own, so that every round has another one.
    """
    sizes = members.groupBy("list_id", "component").agg(F.count("*").alias("size"), F.max(F.struct("lists", "node")).alias("first"))
    largest_ = sizes.groupBy("list_id").agg(F.max(F.struct("size", "component")).alias("top"))
    outside = sizes.join(largest_, "list_id").where((F.col("component") != F.col("top.component")) | (F.col("top.size") == 1))
    leaders = outside.groupBy("list_id").agg(F.max(F.struct(F.col("first.lists"), F.col("first.node"), F.col("component"))).alias("lead"))
    led_ = members.join(leaders, "list_id").where(F.col("component") != F.col("lead.component"))
    return led_.select(F.least("node", "lead.node").alias("u"), F.greatest("node", "lead.node").alias("v")).distinct()


def dealt(members: DataFrame) -> DataFrame:
    """(list_id, node, component, n) -> the same in blocks p <= q, each member with the block it is of.

    Pairs of members in block p, or in p and q, are compared where both meet. Members of a list's largest component have
    blocks after all others', which never meet each other: a member goes to as many blocks as the others need.
    """
    weight = F.col("n") / SIDE_BYTES + 1 / SIDE
    sizes = members.groupBy("list_id", "component").agg(F.sum(weight).alias("weight"))
    lists_ = sizes.groupBy("list_id").agg(F.sum("weight").alias("all"), F.max(F.struct("weight", "component")).alias("top"))
    one = F.col("all") <= 1
    lists_ = lists_.select("list_id", F.when(~one, F.col("top.component")).alias("top"), F.when(one, 1).otherwise(F.ceil(F.col("all") - F.col("top.weight"))).cast("int").alias("others"), F.when(one, 0).otherwise(F.ceil(F.col("top.weight"))).cast("int").alias("tops"))
    own = F.when(F.col("component") == F.col("top"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    placed = members.join(lists_, "list_id").withColumn("block", own)
    meets = F.when(F.col("block") < F.col("others"), F.sequence(F.lit(0), F.col("others") + F.col("tops") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") - 1))
    met = placed.withColumn("other", F.explode(meets))
    return met.select("list_id", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "component", "n")


def candidates(n: np.ndarray, component: np.ndarray, sketch: pa.Array, here: np.ndarray, there: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, bits in which they differ) of different components that may be similar: one in ``here``, one in ``there`` or also in ``here``."""
    out = [(np.zeros(0, dtype=np.int64),) * 3]
    sides = [(here, here)] if there is None else [(here, there), (there, here)]
    matrices = {side: {width: (rows[at], matrix) for width, at, matrix in _rows_by_width(sketch.take(pa.array(rows)))} for side, rows in enumerate((here, there)) if rows is not None}
    for turn in range(len(sides)):
        for width, (i, x) in matrices[turn].items():
            for other in (width, 2 * width) if turn == 0 else (2 * width,):  # no set is similar to one of more than twice its size
                j, y = matrices[len(sides) - 1 - turn if len(sides) > 1 else 0].get(other, (i[:0], x[:0]))
                if not len(j):
                    continue
                kind = np.dtype(f"<u{min(width, 8)}")
                a, b = (np.ascontiguousarray(_folded(m, width)).view(kind) for m in (x, y))
                for at in range(0, len(i), step := max(1, (1 << 20) // b.size)):
                    k = slice(at, at + step)
                    differ = np.bitwise_count(a[k][:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                    open_ = ~_apart(n[i[k]][:, None], n[j][None, :], differ, percent) & (component[i[k]][:, None] != component[j][None, :])
                    if there is None and other == width:
                        open_ &= i[k][:, None] < j[None, :]
                    p, q = np.nonzero(open_)
                    out.append((i[k][p], j[q], differ[p, q]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def closing(blocks: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (u, v) of open members that sketches allow: ``most`` partners of each member, the nearest; and the list_id of lists that have more."""

    def run(block: pa.Table) -> pa.Table:
        p, q = block.column("p")[0].as_py(), block.column("q")[0].as_py()
        node, n, component, mine = (block.column(c).to_numpy() for c in ("node", "n", "component", "block"))
        here = np.flatnonzero(mine == p)
        there = np.flatnonzero(mine == q) if p < q else None
        i, j, differ = candidates(n, component, block.column("sketch").combine_chunks(), here, there, percent)
        one, two, far = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([differ, differ])
        order = np.lexsort((node[two], far / (n[one] + n[two]), one))
        begin = np.flatnonzero(np.append(True, one[order][1:] != one[order][:-1])) if len(one) else one
        nth = np.arange(len(one)) - np.repeat(begin, np.diff(begin, append=len(one)))
        given = order[nth < most]
        pairs = np.unique(np.stack([np.minimum(one[given], two[given]), np.maximum(one[given], two[given])]), axis=1)
        u, v = node[pairs[0]], node[pairs[1]]
        more = [block.column("list_id")[0].as_py()] * (pairs.shape[1] < len(i))
        return pa.table({"u": pa.concat_arrays([pa.array(np.minimum(u, v)), pa.nulls(len(more), pa.int64())]), "v": pa.concat_arrays([pa.array(np.maximum(u, v)), pa.nulls(len(more), pa.int64())]), "list_id": pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(more, pa.int64())])})

    return blocks.groupBy("list_id", "p", "q").applyInArrow(run, "u bigint, v bigint, list_id bigint")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, component)`` with components that ``links(u, v)`` connect made one."""
    if not links.limit(1).count():
        return labels
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias("a" if c == "u" else "b"))
    found = components(links.join(of("u"), "u").join(of("v"), "v").select("a", "b")).select(F.col("component").alias("into"), F.col("id").alias("component"))
    return cut(labels.join(found, "component", "left").select("node", F.coalesce("into", "component").alias("component")))


def still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of lists that still hold several components, after a leader was compared: of two members that is all."""
    inside = members.join(labels, "node").groupBy("list_id").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    return cut(members.join(inside.where("low <> high AND size > 2").select("list_id"), "list_id", "left_semi"))


def merged(members: DataFrame) -> DataFrame:
    """(list_id, node) -> as many lists or fewer: nodes that share a list still share one.

    Near copies share many lists of much the same nodes, and each list would compare and give their pairs once more. Lists that have
    the same first node, the one of most lists, become one list, unless that has more pairs than they have together. This is
    repeated while it saves a tenth of the members. Two lists of one number would only make more candidates, and no link.
    """
    before = members.count()
    while before:
        listed = members.groupBy("node").agg(F.count("*").alias("lists"))
        firsts = members.join(listed, "node").groupBy("list_id").agg(F.max(F.struct("lists", "node")).alias("first"), F.count("*").alias("size"))
        firsts = cut(firsts.select("list_id", F.col("first.node").alias("first"), "size"))
        apart = firsts.groupBy("first").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"), F.count("*").alias("lists")).where("lists > 1")
        one = members.join(firsts.join(apart.select("first"), "first", "left_semi"), "list_id").select("first", "node").distinct().groupBy("first").agg(F.count("*").alias("n"))
        gains = apart.join(one, "first").where("n * n <= pairs").select("first", F.xxhash64(F.lit("merged"), "first").alias("into"))
        into = firsts.join(gains, "first", "left").select("list_id", F.coalesce("into", "list_id").alias("into"))
        members = cut(members.join(into, "list_id").select(F.col("into").alias("list_id"), "node").distinct())
        now = members.count()
        if 10 * now > 9 * before:
            break
        before = now
    return members


def join(docs: DataFrame, *, percent: int = PERCENT, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id that links reach), tag (the text's xxhash64)."""
    if not 50 <= percent <= 100:
        raise ValueError("similarities from 50 to 100 percent are supported")
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = cut(profiles(docs, percent, width))
    rows = profile.where("what = 0")
    members = cut(lists(docs, measure(profile, percent), percent, width))
    # A node that stands in many lists is near to many: it leads its lists, and the first comparisons are with leaders.
    listed = members.groupBy("node").agg(F.count("*").alias("lists"))
    nodes = cut(rows.where("n > 0 AND doc_id IS NOT NULL").join(listed, "node").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("lists").alias("lists"), F.first("sketch").alias("sketch")))
    labels = nodes.select("node", F.col("rep").alias("component"))
    for _ in range(STARS):
        pairs = led(members.join(nodes.select("node", "lists"), "node").join(labels, "node"))
        labels = joined(labels, cut(verify(pairs, nodes, docs, percent, width)))
        members = still_open(members, labels)
    members = merged(members)
    most = NEAREST
    while members.limit(1).count():
        blocks = dealt(members.join(labels, "node").join(nodes.select("node", "n"), "node")).join(nodes.select("node", "sketch"), "node")
        found = cut(closing(blocks, percent, most))
        labels = joined(labels, cut(verify(found.where("u IS NOT NULL").select("u", "v").distinct(), nodes, docs, percent, width)))
        members = still_open(members.join(found.select("list_id").distinct(), "list_id", "left_semi"), labels)
        most *= NEAREST
    known = labels.select("node", "component")
    first = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep")).join(known, "node", "left").select("node", F.coalesce("component", "rep").alias("component"))
    linked = rows.join(first, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "tag")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: near copies among all documents, by shingles of five words at a similarity of 0.8."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
