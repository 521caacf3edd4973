"""Best-fit packing of documents into sequences by minimum bin slack.

A sequence takes the largest piece that is left and, by a bitset subset-sum dynamic programme over the
lengths still available, the combination of others that fills it best; the combination is removed and the
next sequence begins. Only lengths matter to this, so it runs on their histogram: at most ``capacity``
counters, whatever the number of documents. A combination is used as often as the counters allow at
once, which is what filling one sequence after another would do.

Pieces are then dealt to the plan by their number among the pieces of the same length. The numbers are
made in ranges of ids, each from where the one before it ends, so a length that a third of all
pieces have isn't collected anywhere. The plan holds at most ``capacity`` combinations at a time of at most
90 lengths (distinct lengths that add up to 4096), so it is small and is broadcast.

Defined results: null or empty text is the end token alone; equal rows are pieces of their own; an empty
table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import bound_batches, cut, partitions, table


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``; large lengths are tried first."""
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            new = (reached | reached << (k * length)) & mask
            if new != reached:
                steps.append((length, k, reached))
                reached = new
            left -= k
            k *= 2
        if reached >> room:
            break
    total, out = reached.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + k
            total -= k * length
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a sequence with how many of each, how many such sequences), together using every piece."""
    counts, out = {x: n for x, n in histogram.items() if n > 0}, []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        chosen = fullest({x: n for x, n in counts.items() if n}, capacity - largest)
        counts[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((chosen, times))
    return out


def pack(pieces: DataFrame, *, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (a ``length`` column from 1 to ``capacity``, and ``order``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    dealt = pieces.withColumn("__range", F.pmod(F.xxhash64(*order), F.lit(4 * partitions(spark))))
    counts = cut(dealt.groupBy("length", "__range").agg(F.count("*").alias("__n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `capacity` rows
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for chosen, times in plan(histogram, capacity):
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], used[length] + copies * times, copies, sequence, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    slots = spark.createDataFrame(rows, "length bigint, __from bigint, __to bigint, __copies bigint, __sequence bigint, __offset bigint")
    upto = W.partitionBy("length").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "__range", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
    numbered = dealt.withColumn("__place", F.row_number().over(W.partitionBy("length", "__range").orderBy(*order)) - 1).join(starts, ["length", "__range"])
    numbered = numbered.withColumn("__rank", F.col("__start") + F.col("__place"))
    at = numbered.alias("n").join(F.broadcast(slots.alias("s")), (F.col("n.length") == F.col("s.length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    within = F.col("__rank") - F.col("__from")
    return at.select(
        *[F.col(f"n.{c}") for c in pieces.columns],
        (F.col("__sequence") + F.floor(within / F.col("__copies"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + within % F.col("__copies") * F.col("n.length")).cast("long").alias("offset"),
    )


def cut_documents(docs: DataFrame, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` the ids themselves."""
    path = path or tokens.default_path()
    bound_batches(docs.sparkSession)
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = tokens.words(path), end_id.to_bytes(4, "little")
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            ids = []
            doc_ids, pieces, starts, lengths, crcs = columns
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                all_ids = (known.encode(text.as_buffer().to_pybytes()) if text.is_valid else b"") + end
                for k, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    part = all_ids[at : at + 4 * capacity]
                    doc_ids.append(doc)
                    pieces.append(k)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
            arrays = [pa.array(x, kind) for x, (_, kind) in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.binary())] * keep_ids, names=[n for n, _ in kinds] + ["ids"] * keep_ids)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, *, capacity: int = 4096, **options) -> DataFrame:
    """All documents as pieces, each with its sequence and its place there."""
    return pack(cut(cut_documents(docs, capacity=capacity, **options)), capacity=capacity)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents in sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
