"""Read filters: reads with an ambiguous base go, alone or with their mates; counters and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import is_ambiguous


def clean_reads(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """Reads of A, C, G and T alone; null sequences go."""
    return reads.where(F.col(seq).isNotNull() & ~is_ambiguous(F.col(seq)))


def filter_counts(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: reads, kept, dropped, and the percentage dropped."""
    bad = is_ambiguous(F.col(seq))
    out = reads.agg(F.count("*").alias("n_reads"), F.count_if(~bad).alias("n_kept"), F.count_if(bad).alias("n_dropped"))
    return out.withColumn("pct_dropped", F.round(F.coalesce(F.try_divide(100.0 * F.col("n_dropped"), F.col("n_reads")), F.lit(0.0)), 6))


def dropped_base_tally(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """(base, n): how often each ambiguous base occurs in the reads that go."""
    bases = F.explode(F.regexp_extract_all(F.col(seq), F.lit("[^ACGTacgt]"), F.lit(0)))
    return reads.where(is_ambiguous(F.col(seq))).select(bases.alias("base")).groupBy("base").agg(F.count("*").alias("n"))


def pair_up(first: DataFrame, second: DataFrame, on: str = "ord", seq: str = "seq") -> DataFrame:
    """Mates by their place in both files; a place that one file lacks is an error, as unequal files are."""
    a = first.select(on, *[F.col(c).alias(f"{c}1") for c in first.columns if c != on])
    b = second.select(on, *[F.col(c).alias(f"{c}2") for c in second.columns if c != on])
    joined = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), on, "full_outer")
    whole = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("the two files have different numbers of reads"))).otherwise(F.lit(True))
    return joined.where(whole).drop("__a", "__b")


def clean_pairs(pairs: DataFrame, seq: str = "seq") -> DataFrame:
    """Pairs of which both mates are clean."""
    return pairs.where(~(is_ambiguous(F.col(f"{seq}1")) | is_ambiguous(F.col(f"{seq}2"))))


def pair_counts(pairs: DataFrame, seq: str = "seq") -> DataFrame:
    a, b = is_ambiguous(F.col(f"{seq}1")), is_ambiguous(F.col(f"{seq}2"))
    return pairs.agg(
        F.count("*").alias("n_pairs"), F.count_if(~(a | b)).alias("n_kept"), F.count_if(a & ~b).alias("only_first"),
        F.count_if(b & ~a).alias("only_second"), F.count_if(a & b).alias("both"),
    )


def nothing_kept(counts: DataFrame) -> DataFrame:
    """The counters; a run that keeps nothing is an error."""
    return counts.where(F.when(F.col("n_kept") == 0, F.raise_error(F.lit("no read is left"))).otherwise(F.lit(True)))
