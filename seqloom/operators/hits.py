"""From seeds to places: every occurrence of a seed, sampled evenly if there are too many, and its contig."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expand(seeds: DataFrame, matches: DataFrame, max_occ: int = 500) -> DataFrame:
    """(read_id, qbeg, len, occ, rid, strand, pos): the places of each seed; ``occ`` counts those given.

    Of ``n`` > ``max_occ`` places every (n // max_occ)-th is given, by position, at most ``max_occ``.
    """
    m = matches.select("read_id", "rid", "strand", F.col("qbeg").alias("b"), F.col("rbeg").alias("r"), (F.col("qbeg") + F.col("len")).alias("e"))
    once = seeds.select("read_id", "qbeg", "len").distinct()
    met = once.join(m, "read_id").where((F.col("b") <= F.col("qbeg")) & (F.col("e") >= F.col("qbeg") + F.col("len")))
    placed = met.select("read_id", "qbeg", "len", "rid", "strand", (F.col("r") + F.col("qbeg") - F.col("b")).alias("pos"))
    one = W.partitionBy("read_id", "qbeg", "len")
    ranked = placed.withColumn("nth", F.row_number().over(one.orderBy("rid", "strand", "pos")) - 1).withColumn("width", F.count("*").over(one))
    step = F.greatest(F.lit(1), F.floor(F.col("width") / max_occ))
    taken = ranked.where((F.col("nth") % step == 0) & (F.floor(F.col("nth") / step) < max_occ))
    return taken.withColumn("occ", F.count("*").over(one)).select("read_id", "qbeg", "len", "occ", "rid", "strand", "pos")


def pos_to_contig(places: DataFrame, contig_table: DataFrame, bin_size: int = 1 << 16) -> DataFrame:
    """``places(pos, len, ..)`` on the concatenated reference -> with ``rid`` and ``contig_pos``; -1 if a stretch bridges contigs.

    A range join as an equi-join: contigs stand in all bins that they touch, places in the bin of their start.
    """
    spread = contig_table.where("len > 0").select("rid", "offset", F.col("len").alias("size"), F.explode(F.sequence(F.floor(F.col("offset") / bin_size), F.floor((F.col("offset") + F.col("len") - 1) / bin_size))).alias("bin"))
    met = places.withColumn("bin", F.floor(F.col("pos") / bin_size)).join(spread, "bin", "left")
    inside = met.where((F.col("pos") >= F.col("offset")) & (F.col("pos") < F.col("offset") + F.col("size")))
    whole = F.col("pos") + F.col("len") <= F.col("offset") + F.col("size")
    return inside.select(*places.columns, F.when(whole, F.col("rid")).otherwise(F.lit(-1)).cast("long").alias("rid"), (F.col("pos") - F.col("offset")).alias("contig_pos"))


def doubled(hits: DataFrame, contig_table: DataFrame, total: int, reads: DataFrame) -> DataFrame:
    """Hits with what chaining needs: the read's length ``n``, and the contig's doubled ``base``, ``size`` and ``is_alt``."""
    alt = F.col("is_alt") if "is_alt" in contig_table.columns else F.lit(False)
    c = contig_table.select("rid", "offset", F.col("len").alias("size"), alt.alias("is_alt"))
    base = F.when(F.col("strand") == 0, F.col("offset")).otherwise(F.lit(2 * total) - F.col("offset") - F.col("size"))
    return hits.join(c, "rid").withColumn("base", base).join(reads.select("read_id", F.length("seq").alias("n")), "read_id")


def windows(wanted: DataFrame, chunks: DataFrame, chunk: int = 256, piece: int = 65_536) -> DataFrame:
    """``wanted(key.., rid, strand, size, beg, end)``, places on the contig's strand -> with ``target``, the text there."""
    keys = [c for c in wanted.columns if c not in ("beg", "end")]
    fwd_beg = F.when(F.col("strand") == 0, F.col("beg")).otherwise(F.col("size") - F.col("end"))
    fwd_end = F.when(F.col("strand") == 0, F.col("end")).otherwise(F.col("size") - F.col("beg"))
    asked = wanted.withColumns({"fb": fwd_beg, "fe": fwd_end}).where("fe > fb")
    asked = asked.withColumn("no", F.explode(F.sequence(F.floor(F.col("fb") / chunk), F.floor((F.col("fe") - 1) / chunk))))
    text = chunks.where("strand = 0").select("rid", F.floor(F.col("start") / chunk).alias("no"), "start", F.substr("bases", F.lit(1), F.col("own")).alias("bases"))
    met = asked.join(text, ["rid", "no"]).groupBy(*keys, "beg", "end", "fb", "fe").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "bases"))), lambda x: x["bases"]), "").alias("all"), F.min("start").alias("from"))
    fwd = F.substr("all", (F.col("fb") - F.col("from") + 1).cast("int"), (F.col("fe") - F.col("fb")).cast("int"))
    turned = F.when(F.col("strand") == 0, fwd).otherwise(F.reverse(F.translate(fwd, "ACGT", "TGCA")))
    return met.select(*keys, "beg", "end", turned.alias("target"))
