"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract here has it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the bitmap that ``among`` broadcasts: 4 MB.
BITS = 1 << 25
#: Bytes of an Arrow batch, and Spark's setting for it.
BATCH, _BATCH = 8_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's setting that ends the life of an execution's shuffle files with the execution.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session that names none (a local test) gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return named or tempfile.mkdtemp(prefix="seqloom-checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, without its lineage.

    Executors may be lost later: the files are on shared storage. Nothing reads the shuffles of this execution
    again, so Spark is told to delete their files as it ends; the setting holds for frames that are made under it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def among(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``rows`` less most of those whose id isn't in the only column of ``ids``: what is left still has to be joined.

    A bitmap of hashes, ``BITS`` bits for any input, is broadcast, so that wide rows nobody asks for are
    not shuffled. With more ids than bits it lets everything through, and the join after it does the same as before.
    """
    bit = lambda c: F.pmod(F.xxhash64(F.lit(23), c), F.lit(BITS))
    asked = ids.select(bit(F.col(ids.columns[0])).alias("bit"))
    bitmap = asked.groupBy(F.bitmap_bucket_number("bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bitmap"))
    place = F.bitmap_bit_position(bit(F.col(id_col)))
    byte = F.conv(F.hex(F.substring("__bitmap", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.getbit(byte, (place % 8).cast("int")) == 1
    return rows.join(F.broadcast(bitmap), (F.bitmap_bucket_number(bit(F.col(id_col))) == F.col("__bucket")) & has, "left_semi")


_memory: dict = {}


def memory(operator: str, key, make):
    """What a Python worker remembers from one partition to the next for an operator: that of any other operator goes first.

    Workers are used again by later stages, so each holds one bounded memory and not one of each operator that ever ran.
    """
    if _memory.get("for") != (operator, key):
        from .bytewise import give_back

        _memory.clear()
        gc.collect()
        give_back()
        _memory.update({"for": (operator, key), "value": make()})
    return _memory["value"]


def forget(operator: str) -> None:
    """For an operator that remembers nothing: drops what this worker remembers for another, which would lie beside its work."""
    memory(operator, None, lambda: None)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(col: str, n: int) -> Column:
    """CRC-32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH`` bytes for this session, unless it says otherwise: Spark's own 64 MB, held in the JVM and in
    Python by each task, are much beside long texts."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH))


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is sized for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
