"""FASTA, FASTQ and SAM text as tables, through Spark's own readers, so any store and codec that they open will do.

Text rows have no numbers, so lines are counted: rows of one file split stand together in a task, in
order, which gives a line's place in its split, and the splits' line counts give where each begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.encode import trim_mate


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines from 0 in each file, without a closing carriage return."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("file", "block").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    starts = splits.withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return raw.join(F.broadcast(starts.select("file", "block", "low", "start")), ["file", "block"]).select("file", (F.col("start") + F.col("id") - F.col("low")).alias("line_no"), "value")  # a row a file split


def _name(header: Column) -> Column:
    return F.regexp_extract(header, r"^.(\S*)", 1)


def _comment(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, r"^\S*\s+(.*)$", 1), F.lit(""))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, comment, seq, qual) of four-line records; a torn record, or one of unequal lengths, is an error."""
    lines = numbered_lines(spark, path)
    part = lambda i: F.max(F.when(F.col("line_no") % 4 == i, F.col("value")))
    rows = lines.groupBy("file", F.floor(F.col("line_no") / 4).alias("ord")).agg(part(0).alias("header"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual"))
    blank = F.col("header").isin("") & F.col("qual").isNull()
    torn = F.col("qual").isNull() | ~F.col("header").startswith("@") | ~F.col("plus").startswith("+") | (F.length("seq") != F.length("qual"))
    ok = F.when(torn, F.raise_error(F.concat(F.lit("torn record "), F.col("ord").cast("string"), F.lit(" in "), F.col("file")))).otherwise(F.lit(True))
    return rows.where(~blank).where(ok).select("file", "ord", trim_mate(_name(F.col("header"))).alias("name"), _comment(F.col("header")).alias("comment"), "seq", "qual")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, rid, name, anno, seq): records from 0 in each file, their lines joined."""
    lines = numbered_lines(spark, path).where("value <> ''").withColumn("head", F.col("value").startswith(">").cast("long"))
    block = F.floor(F.col("line_no") / 65_536)
    lines = lines.withColumn("b", block)
    totals = lines.groupBy("file", "b").agg(F.sum("head").alias("n"))
    starts = totals.withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counted = lines.withColumn("own", F.sum("head").over(W.partitionBy("file", "b").orderBy("line_no"))).join(starts.select("file", "b", "start"), ["file", "b"])
    rows = counted.withColumn("rid", F.col("start") + F.col("own") - 1).where("rid >= 0")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("head") == 0, F.struct("line_no", "value")))), lambda x: x["value"]), "")
    out = rows.groupBy("file", "rid").agg(F.max(F.when(F.col("head") == 1, F.col("value"))).alias("header"), text.alias("seq"))
    return out.select("file", "rid", _name(F.col("header")).alias("name"), _comment(F.col("header")).alias("anno"), "seq")


def read_alt(spark: SparkSession, path: str) -> DataFrame:
    """(name): first columns, lines that begin with @ left out."""
    return spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.split("value", "\t")[0].alias("name"))


def parse_cigar(text: Column) -> Column:
    """``5S90M`` as an array of (len, op); * as null."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.when(text != "*", F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("int").alias("len"), F.substring(x, -1, 1).alias("op"))))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text, in file order (``ord``), with flags apart and the NM tag."""
    rows = numbered_lines(spark, path).where("value <> '' AND NOT startswith(value, '@')").select("file", F.col("line_no").alias("ord"), F.split("value", "\t").alias("f"))
    flag = F.col("f")[1].cast("int")
    bit = lambda x: flag.bitwiseAND(x) > 0
    nm = F.filter(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda x: x.startswith("NM:i:"))
    return rows.select(
        "file", "ord", F.col("f")[0].alias("qname"), flag.alias("flag"), bit(0x1).alias("is_paired"), (bit(0x40) | ~bit(0x1)).alias("is_read1"), bit(0x4).alias("is_unmapped"), bit(0x10).alias("is_reverse"),
        bit(0x100).alias("is_secondary"), bit(0x800).alias("is_supplementary"), F.col("f")[2].alias("rname"), (F.col("f")[3].cast("int") - 1).alias("pos"), F.col("f")[4].cast("int").alias("mapq"),
        parse_cigar(F.col("f")[5]).alias("cigar"), F.regexp_extract(F.get(nm, F.lit(0)), r"\d+", 0).cast("int").alias("nm"), F.when(F.col("f")[9] != "*", F.length(F.col("f")[9])).alias("qlen"), F.col("f")[9].alias("seq"),
    )


def smart_pairs(reads: DataFrame) -> DataFrame:
    """Reads of one file in which mates stand next to each other: ``pair`` and ``mate`` (0, 1), or mate null if single.

    Of a run of equal names the first two are a pair, the next two, and so on; the odd one out is single.
    """
    block = F.floor(F.col("ord") / 65_536)
    # Names before a block's first read are needed to know whether a run goes on: they come from the read before.
    before = reads.select((F.col("ord") + 1).alias("ord"), F.col("name").alias("last"))
    marked = reads.join(before, "ord", "left").withColumn("new", (~F.col("last").eqNullSafe(F.col("name"))).cast("long")).withColumn("b", block)
    totals = marked.groupBy("b").agg(F.sum("new").alias("n"))
    starts = totals.select("b", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    runs = marked.withColumn("own", F.sum("new").over(W.partitionBy("b").orderBy("ord"))).join(starts, "b").withColumn("run", F.col("start") + F.col("own"))
    nth = F.row_number().over(W.partitionBy("run").orderBy("ord")) - 1
    sized = runs.withColumn("nth", nth).withColumn("size", F.count("*").over(W.partitionBy("run")))
    paired = F.col("nth") < F.col("size") - F.col("size") % 2
    return sized.select(*reads.columns, F.struct("run", F.floor(F.col("nth") / 2).alias("no")).alias("pair"), F.when(paired, F.col("nth") % 2).cast("int").alias("mate"))


def write_fastq(reads: DataFrame, path: str, order: str = "ord") -> None:
    """A folder of FASTQ parts, in order."""
    text = F.concat(F.lit("@"), "name", F.coalesce(F.concat(F.lit(" "), "comment"), F.lit("")) if "comment" in reads.columns else F.lit(""), F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    reads.orderBy(order).select(text.alias("value")).write.mode("overwrite").text(path)
