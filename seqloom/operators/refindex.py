"""Reference tables: contigs, ambiguous runs, chunks of text on both strands, and the k-mer index.

Coordinates are doubled: a position p of the concatenated reference of L bases has its reverse complement
at 2L - 1 - p. Chunks carry the k - 1 bases that follow, so every k-mer lies in one chunk, and no k-mer
crosses contigs. Long sequences are cut in one pass from left to right, at two sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.encode import clean, pieces, revcomp

PIECE, CHUNK = 65_536, 256
#: Ids that are numbered or summed up in one task.
RANGE = 65_536


def running(df: DataFrame, order: str, value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of smaller ``order`` (a whole number, unique).

    Sums are made within ranges of ``order`` and over the ranges' totals: no task sees all rows.
    """
    ranged = df.withColumn("__v", value).withColumn("__r", F.floor(F.col(order) / RANGE))
    totals = ranged.groupBy("__r").agg(F.sum("__v").alias("__t"))
    starts = totals.select("__r", F.coalesce(F.sum("__t").over(W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    inside = W.partitionBy("__r").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumn("__w", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return summed.join(starts, "__r").withColumn(out, (F.col("__s") + F.col("__w")).cast("long")).drop("__v", "__r", "__w", "__s")


def contigs(seqs: DataFrame) -> DataFrame:
    """``seqs(rid, name, seq)``, rid giving the order -> (rid, name, offset, len, n_ambs)."""
    runs = F.size(F.regexp_extract_all(F.upper("seq"), F.lit(r"([^ACGT])\1*"), F.lit(0)))
    measured = seqs.select("rid", "name", F.length("seq").cast("long").alias("len"), runs.cast("long").alias("n_ambs"))
    return running(measured, "rid", F.col("len"), "offset").select("rid", "name", "offset", "len", "n_ambs")


def holes(seqs: DataFrame) -> DataFrame:
    """(rid, start, len, amb): runs of one ambiguous character, with their places in the contig."""
    parts = F.regexp_extract_all(F.upper("seq"), F.lit(r"[ACGT]+|([^ACGT])\1*"), F.lit(0))
    placed = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,len:bigint,amb:string>>").alias("runs")),
        lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.when(x.rlike("^[ACGT]"), acc["runs"]).otherwise(F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("start"), F.length(x).cast("long").alias("len"), F.substring(x, 1, 1).alias("amb"))))).alias("runs")))
    return seqs.select("rid", F.explode(placed["runs"]).alias("h")).select("rid", "h.start", "h.len", "h.amb")


def ref_chunks(seqs: DataFrame, k: int = 14, both: bool = True) -> DataFrame:
    """(rid, strand, start, own, bases): the text in chunks, ambiguous bases as A.

    ``start`` counts from the contig's first base on strand 0 and from its last on strand 1. Chunks of
    strand 1 mirror those of strand 0, so ``bases`` begins with the overlap of the chunk before it.
    """
    text = seqs.select("rid", F.length("seq").cast("long").alias("len"), F.explode(pieces(clean(F.col("seq")), PIECE, k - 1)).alias("p"))
    small = text.select("rid", "len", F.col("p.start").alias("base"), F.col("p.own").alias("most"), F.explode(pieces(F.col("p.bases"), CHUNK, k - 1)).alias("c"))
    small = small.where(F.col("c.start") < F.col("most"))
    fwd = small.select("rid", F.lit(0).alias("strand"), "len", (F.col("base") + F.col("c.start")).alias("start"), F.least(F.col("c.own"), (F.col("most") - F.col("c.start")).cast("int")).alias("own"), F.col("c.bases").alias("bases"))
    out = fwd.select("rid", "strand", "start", "own", "bases")
    if both:
        back = fwd.select("rid", F.lit(1).alias("strand"), (F.col("len") - F.col("start") - F.length("bases")).alias("start"), "own", revcomp(F.col("bases")).alias("bases"))
        out = out.unionByName(back)
    return out


def kmer_positions(chunks: DataFrame, k: int = 14) -> DataFrame:
    """(kmer, rid, strand, pos): every k-mer of the chunks, once."""
    # A chunk's bases hold own + k - 1 bases at most, that is, exactly the k-mers that begin (strand 1: end) in it.
    n = F.length("bases") - k
    at = chunks.where(n >= 0).select("rid", "strand", "start", "bases", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    return at.select(F.substr("bases", F.col("i") + 1, F.lit(k)).alias("kmer"), "rid", "strand", (F.col("start") + F.col("i")).cast("long").alias("pos"))


def kmer_index(chunks: DataFrame, k: int = 14) -> DataFrame:
    """(kmer, occ, first_rid, first_pos): the number of places, and the place of a unique one."""
    return kmer_positions(chunks, k).groupBy("kmer").agg(F.count("*").alias("occ"), F.min(F.struct("rid", "strand", "pos")).alias("first"))


def kmer_classes(index: DataFrame) -> DataFrame:
    """(class, n): k-mers with one place and with several."""
    return index.groupBy(F.when(F.col("occ") == 1, "unique").otherwise("multi").alias("class")).agg(F.count("*").alias("n_kmers"), F.sum("occ").alias("n_places"))


def validate(index: DataFrame) -> DataFrame:
    """One row: whether each k-mer has as many places as its reverse complement (both strands are indexed)."""
    back = revcomp(F.col("kmer"))
    is_first = F.col("kmer") <= back
    # Each k-mer meets its reverse complement in one group; one that is its own stands on both sides.
    sides = index.select(F.least("kmer", back).alias("both"), F.when(is_first, F.col("occ")).alias("a"), F.when(~is_first | (F.col("kmer") == back), F.col("occ")).alias("b"), (F.col("kmer") == back).alias("own"))
    met = sides.groupBy("both").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("own").alias("own"))
    n, places = F.count("a") + F.count("b") - F.count_if("own"), F.coalesce(F.sum("a"), F.lit(0)) + F.coalesce(F.sum(F.when(~F.col("own"), F.col("b"))), F.lit(0))
    unequal = F.coalesce(F.sum(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("a").isNotNull().cast("long") + F.col("b").isNotNull().cast("long"))), F.lit(0))
    return met.agg(n.alias("n_kmers"), F.when(n > 0, places).alias("n_places"), unequal.cast("long").alias("n_unequal"))


def prepared_counts(seqs: DataFrame) -> DataFrame:
    """One row: bases, and how many N and other ambiguous ones were replaced."""
    up = F.upper("seq")
    n, other = F.length(F.regexp_replace(up, "[^N]", "")), F.length(F.regexp_replace(up, "[ACGTN]", ""))
    return seqs.agg(F.sum(F.length("seq")).cast("long").alias("n_bases"), F.sum(n).cast("long").alias("n_replaced"), F.sum(other).cast("long").alias("n_other"))


def mark_alt(contig_table: DataFrame, alt: DataFrame) -> DataFrame:
    """Contigs with ``is_alt``, by the names in ``alt``."""
    names = alt.select("name").where(~F.col("name").startswith("@")).distinct().withColumn("is_alt", F.lit(True))
    return contig_table.join(names, "name", "left").withColumn("is_alt", F.coalesce("is_alt", F.lit(False)))
