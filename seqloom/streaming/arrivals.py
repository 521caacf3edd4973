"""Reads that arrive as FASTQ files in a folder: each micro-batch is aligned as a batch run would align it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.encode import trim_mate
from ..options import Options
from ..plans import align as plans


def records(files: DataFrame) -> DataFrame:
    """(file, ord, name, seq, qual) of whole FASTQ files (``value``, ``file``); a torn record is an error."""
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), r"\n+$", ""), "\n")
    ok = F.when(F.size(lines) % 4 != 0, F.raise_error(F.concat(F.lit("torn record in "), F.col("file")))).otherwise(lines)
    each = files.select("file", ok.alias("l")).select("file", "l", F.explode(F.sequence(F.lit(0), (F.size("l") / 4).cast("int") - 1)).alias("ord"))
    at = lambda i: F.get("l", F.col("ord") * 4 + i)
    return each.select("file", "ord", trim_mate(F.regexp_extract(at(0), r"^@(\S*)", 1)).alias("name"), at(1).alias("seq"), at(3).alias("qual"))


def align_arrivals(spark: SparkSession, folder: str, index: plans.Index, out: str, checkpoint: str, o: Options | None = None) -> StreamingQuery:
    """Starts a query that aligns each new file of ``folder`` and writes Parquet under ``out``, a folder a batch, so a
    repeated batch replaces itself."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder).select("value", F.col("_metadata.file_path").alias("file"))

    def batch(df: DataFrame, number: int) -> None:
        reads = records(df).withColumn("read_id", F.pmod(F.xxhash64("file", "ord"), F.lit(1 << 62)))
        found = plans.align(reads.select("read_id", "seq"), index, o)
        reads.select("read_id", "name").join(found, "read_id", "left").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
