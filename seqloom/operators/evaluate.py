"""Alignment evaluation: two tables of alignments of the same reads, compared read by read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Position tolerances in bases, and bounds on edits as shares of a read's length.
STRICT, STANDARD, STRUCTURAL, CONSISTENT = 5, 50, 0.05, 0.10
FIELDS = ["is_unmapped", "is_reverse", "rname", "pos", "cigar", "nm", "qlen"]


def primary(alignments: DataFrame) -> DataFrame:
    return alignments.where("NOT is_secondary AND NOT is_supplementary")


def paired(reference: DataFrame, test: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each (qname, is_read1) of either side, with structs ``a`` and ``b``; of repeated keys the last by ``order`` counts."""

    def side(df: DataFrame, name: str) -> DataFrame:
        df = primary(df)
        fields = F.struct(*[F.col(c) for c in FIELDS])
        if order:
            last = df.groupBy("qname", "is_read1").agg(F.max_by(fields, order).alias(name))
            return last
        return df.select("qname", "is_read1", fields.alias(name))

    return side(reference, "a").join(side(test, "b"), ["qname", "is_read1"], "full_outer")


def lockstep(reference: DataFrame, test: DataFrame) -> DataFrame:
    """Pairs by place (``ord``) in both tables; names that differ are an error."""
    a, b = primary(reference), primary(test)
    numbered = lambda df, n: df.withColumn("place", F.row_number().over(W.orderBy("ord"))).select("place", F.struct("qname", "is_read1", *FIELDS).alias(n))
    joined = numbered(a, "a").join(numbered(b, "b"), "place", "full_outer")
    same = F.col("a.qname").eqNullSafe(F.col("b.qname")) & F.col("a.is_read1").eqNullSafe(F.col("b.is_read1"))
    return joined.where(F.when(~same, F.raise_error(F.lit("the two tables are not in the same order"))).otherwise(F.lit(True)))


def verdict(tolerance: int, any_contig: bool = False) -> Column:
    """TN, FN, FP or TP of a pair; a read that one side lacks counts as unmapped there."""
    a_mapped = F.col("a").isNotNull() & ~F.coalesce(F.col("a.is_unmapped"), F.lit(True))
    b_mapped = F.col("b").isNotNull() & ~F.coalesce(F.col("b.is_unmapped"), F.lit(True))
    near = (F.col("a.is_reverse") == F.col("b.is_reverse")) & (F.abs(F.col("a.pos") - F.col("b.pos")) <= tolerance)
    if not any_contig:
        near &= F.col("a.rname") == F.col("b.rname")
    return F.when(~a_mapped & ~b_mapped, "TN").when(a_mapped & ~b_mapped, "FN").when(~a_mapped & b_mapped, "FP").when(near, "TP").otherwise("FP")


def confusion(pairs: DataFrame, tolerance: int = STANDARD, any_contig: bool = False) -> DataFrame:
    """One row: tp, fp, fn, tn."""
    v = pairs.select(verdict(tolerance, any_contig).alias("v"))
    return v.agg(*[F.count_if(F.col("v") == x.upper()).alias(x) for x in ("tp", "fp", "fn", "tn")])


def metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy, 0 where there is nothing to divide by."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def edits(cigar: Column, nm: Column) -> Column:
    """The NM tag, else inserted, deleted and mismatched (X) bases of the CIGAR."""
    counted = F.aggregate(F.filter(cigar, lambda x: x["op"].isin("I", "D", "X")), F.lit(0), lambda acc, x: acc + x["len"].cast("int"))
    return F.coalesce(nm, counted)


def quality(pairs: DataFrame) -> DataFrame:
    """One row: of the reads that both sides map, how many cost about as many edits on both; of those the test side
    maps, how many cost few edits. A pair without edits to count is not right."""
    ours = F.coalesce(~F.col("b.is_unmapped"), F.lit(False))
    both = ours & F.coalesce(~F.col("a.is_unmapped"), F.lit(False))
    theirs, own = edits(F.col("a.cigar"), F.col("a.nm")), edits(F.col("b.cigar"), F.col("b.nm"))
    like = F.coalesce(F.try_divide(F.abs(theirs - own).cast("double"), F.col("a.qlen").cast("double")) <= STRUCTURAL, F.lit(False))
    few = F.coalesce(F.try_divide(own.cast("double"), F.col("b.qlen").cast("double")) <= CONSISTENT, F.lit(False))
    out = pairs.agg(F.count_if(both).alias("n_both"), F.count_if(both & like).alias("n_structural"), F.count_if(ours).alias("n_mapped"), F.count_if(ours & few).alias("n_consistent"))
    share = lambda c, of: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(of).cast("double")), F.lit(0.0))
    return out.withColumn("structural", share("n_structural", "n_both")).withColumn("consistent", share("n_consistent", "n_mapped"))


def differences(pairs: DataFrame, tolerance: int = STANDARD) -> DataFrame:
    """(qname, is_read1, kind): missed reads, false ones, and those that only the test side maps."""
    v = pairs.withColumn("v", verdict(tolerance))
    only = F.col("a").isNull() | F.coalesce(F.col("a.is_unmapped"), F.lit(True))
    return v.where(F.col("v").isin("FN", "FP")).select("qname", "is_read1", F.when(F.col("v") == "FN", "missed").when(only, "test_only").otherwise("false").alias("kind"))
