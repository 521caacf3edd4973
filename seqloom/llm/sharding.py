"""Shards of equal bytes, tokens and rows, by vector bin packing of groups of equal texts.

A group's vector is its share of all bytes, tokens and rows. Groups are taken from the largest down, and
each goes to the shard for which the dot product of this vector with the shard's residual capacity is
highest. To do this for any number of groups, it is always done in levels: cells of at most ``CELL`` groups or so pack
them into ``BUNDLES`` small bundles each, and bundles are packed as groups are, until those left fit one task, which packs them into the
shards. So no task and no driver ever holds more, and the last level, which has small bundles, evens out what the cells leave.

A group with over a quarter of a shard would upset the balance and would be a hot key: it is split by
the hash of the document ids into pieces of at most a sixteenth of a shard. There are at most
``12 * shards`` such groups (the three shares add up to 3), so these alone are broadcast.

Defined results: null text has no bytes, is a group of its own and its CRC-32 is 0; equal rows are
separate rows with slots of their own; a null doc_id is an id like any other; texts are measured whole however long they are; other
columns take no part; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, table

#: Groups that one task packs, and the bundles it makes of them.
CELL, BUNDLES = 20_000, 512
MEASURES = ["size", "tokens", "n"]


def place(vectors: np.ndarray, n_bins: int) -> np.ndarray:
    """The bin of each row of ``vectors`` (n, 3): largest first, highest dot product with residual capacity."""
    total = np.maximum(vectors.sum(axis=0), 1e-300)
    shares = vectors / total
    left = np.full((n_bins, vectors.shape[1]), 1.0 / n_bins)
    out = np.empty(len(vectors), dtype=np.int64)
    for i in np.argsort(-shares.max(axis=1), kind="stable"):
        out[i] = b = int(np.argmax(left @ shares[i]))
        left[b] -= shares[i]
    return out


def _packer(keys: list[str], n_bins: int):
    def pack(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(keys, kind="stable", ignore_index=True)
        bins = place(cell[MEASURES].to_numpy(dtype=np.float64), n_bins)
        at = cell["cell"].to_numpy(dtype=np.int64)
        return cell[[*keys, *MEASURES]].assign(placed_in=at * n_bins + bins)

    return pack


def assign(items: DataFrame, keys: list[str], n_shards: int) -> DataFrame:
    """``items``: one row for each of ``keys``, with MEASURES -> the keys and ``shard``."""
    cells = max(1, -(-items.count() // CELL))
    fields = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in [*keys, *MEASURES]) + ", placed_in bigint"
    dealt = items.withColumn("cell", F.pmod(F.xxhash64(*keys), F.lit(cells)))
    placed = cut(dealt.groupBy("cell").applyInPandas(_packer(keys, BUNDLES), schema).withColumnRenamed("placed_in", "into"))
    bundles = cut(placed.groupBy(F.col("into").alias("bundle")).agg(*[F.sum(m).alias(m) for m in MEASURES]))
    if cells * BUNDLES > CELL:
        shards = assign(bundles, ["bundle"], n_shards)
    else:
        one = bundles.withColumn("cell", F.lit(0)).groupBy("cell").applyInPandas(_packer(["bundle"], n_shards), f"bundle bigint, {', '.join(f'{m} bigint' for m in MEASURES)}, placed_in bigint")
        shards = one.select("bundle", F.col("placed_in").cast("int").alias("shard"))
    return placed.join(shards.withColumnRenamed("bundle", "of"), F.col("into") == F.col("of")).select(*keys, "shard")


def shard(docs: DataFrame, n_shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens."""
    text = F.col(text_col)
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"),
    ))
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    totals = groups.agg(*[F.greatest(F.coalesce(F.sum(m), F.lit(0)), F.lit(1)).alias(f"all_{m}") for m in MEASURES]).first()
    part = F.greatest(*[F.col(m) / F.lit(float(totals[f"all_{m}"])) for m in MEASURES])
    large = groups.withColumn("pieces", F.least(F.col("n"), F.ceil(part * (16 * n_shards)))).where((part > 1 / (4 * n_shards)) & (F.col("pieces") > 1))
    pieced = rows.join(F.broadcast(large.select("h1", "h2", "pieces")), ["h1", "h2"], "left")
    pieced = pieced.withColumn("piece", F.coalesce(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    items = cut(pieced.groupBy("h1", "h2", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    placed = pieced.join(assign(items, ["h1", "h2", "piece"], n_shards), ["h1", "h2", "piece"])
    # Slots: a shard's rows are numbered in ranges of ids, each range from where the one before it ends.
    ranges = max(16, totals["all_n"] // (n_shards * 50_000))
    placed = placed.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)))
    placed = cut(placed.select("doc_id", "size", "tokens", "text_crc32", "shard", "range", "h1"))
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("rows"))
    upto = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "range", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "range").orderBy("doc_id", "h1")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1).join(counts, ["shard", "range"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents in 16 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"))
