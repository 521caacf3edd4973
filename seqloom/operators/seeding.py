"""Seeding: reads against the k-mer table of a reference, as equi-joins, islands and histograms.

A read's k-mers meet those of the reference; hits on one diagonal that follow each other without a gap are
one maximal exact match. What a pivot (an end position in the read) yields depends only on how many hits
match how far to its left, so each pivot gets a histogram of match lengths, no longer than the read,
and the rules below are expressions on it. Only the walk from pivot to pivot is sequential: a fold over the
read's pivots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.encode import normal, revcomp

#: Positions of one read are numbered with this in combined keys.
SEED = "struct<qbeg:int,len:int,occ:bigint>"


def read_kmers(reads: DataFrame, k: int = 14) -> DataFrame:
    """(read_id, q, kmer): k-mers without an ambiguous base."""
    n = F.length("seq") - k
    at = reads.select("read_id", normal(F.col("seq")).alias("seq")).where(n >= 0)
    return at.select("read_id", F.explode(F.sequence(F.lit(0), n)).alias("q"), "seq").select("read_id", "q", F.substr("seq", F.col("q") + 1, F.lit(k)).alias("kmer")).where("instr(kmer, 'N') = 0")


def maximal_matches(reads: DataFrame, positions: DataFrame, k: int = 14, min_len: int = 0) -> DataFrame:
    """(read_id, rid, strand, qbeg, rbeg, len): maximal exact matches of ``k`` bases or more.

    Both sides of the join carry a k-mer of a few bytes; a frequent one is a skewed key, which adaptive
    execution splits.
    """
    hits = read_kmers(reads, k).join(positions, "kmer").select("read_id", "rid", "strand", "q", "pos", (F.col("pos") - F.col("q")).alias("diag"))
    line = W.partitionBy("read_id", "rid", "strand", "diag").orderBy("q")
    runs = hits.withColumn("run", F.col("q") - F.row_number().over(line)).groupBy("read_id", "rid", "strand", "diag", "run")
    out = runs.agg(F.min("q").alias("qbeg"), F.min("pos").alias("rbeg"), (F.max("q") - F.min("q") + k).cast("int").alias("len"))
    return out.where(F.col("len") >= min_len).select("read_id", "rid", "strand", "qbeg", "rbeg", "len")




def pivots(matches: DataFrame, k: int = 14) -> DataFrame:
    """(read_id, e, hist): for each position with hits, (lce, n, upto) by falling match length; ``upto`` hits are as long or longer."""
    ends = matches.select("read_id", "qbeg", F.explode(F.sequence(F.col("qbeg") + k - 1, F.col("qbeg") + F.col("len") - 1)).alias("e"))
    counted = ends.groupBy("read_id", "e", (F.col("e") - F.col("qbeg") + 1).alias("lce")).agg(F.count("*").alias("n"))
    falling = W.partitionBy("read_id", "e").orderBy(F.col("lce").desc())
    summed = counted.withColumn("upto", F.sum("n").over(falling))
    listed = summed.groupBy("read_id", "e").agg(F.sort_array(F.collect_list(F.struct("lce", "n", "upto")), asc=False).alias("hist"))
    return listed


def _total(hist: Column) -> Column:
    return F.element_at(hist, -1)["upto"]


def _longest(hist: Column) -> Column:
    return hist[0]["lce"]


def _nth(hist: Column, n) -> Column:
    """The n-th largest match length, 0 if there are fewer hits."""
    return F.coalesce(F.get(F.filter(hist, lambda x: x["upto"] >= n), F.lit(0))["lce"], F.lit(0))


def _at_least(hist: Column, length: Column) -> Column:
    """Hits of this match length or more."""
    return F.coalesce(F.array_max(F.transform(F.filter(hist, lambda x: x["lce"] >= length), lambda x: x["upto"])), F.lit(0))


def _lattice_up(x: Column, k: int, step: int) -> Column:
    return (k + F.ceil(F.greatest(x - k, F.lit(0)) / step) * step).cast("int")


def _lattice_down(x: Column, k: int, step: int) -> Column:
    return (k + F.floor((x - k) / step) * step).cast("int")


def longest_match(hist: Column, k: int = 14, step: int = 1) -> Column:
    """(len, occ) of the longest match at a pivot; with step 2 lengths are k, k + 2, ... unless one hit is left."""
    m, second, total = _longest(hist), _nth(hist, 2), _total(hist)
    if step == 1:
        return F.struct(m.cast("int").alias("len"), hist[0]["n"].alias("occ"))
    single = F.when(total == 1, F.lit(k)).otherwise(k + step * (F.floor((second - k) / step) + 1))
    last = _lattice_down(m, k, step)
    alone = single <= m
    return F.struct(F.when(alone, m).otherwise(last).cast("int").alias("len"), F.when(alone, F.lit(1)).otherwise(_at_least(hist, last)).cast("long").alias("occ"))


def shortest_specific(hist: Column, k: int = 14, step: int = 1, min_len: int = 20, limit: int = 20) -> Column:
    """(len, occ) of the shortest match at a pivot that is long enough and rare enough; the longest one if none is."""
    m, second, total = _longest(hist), _nth(hist, 2), _total(hist)
    low = _lattice_up(F.greatest(F.lit(min_len), _nth(hist, limit) + 1, F.lit(k + step)), k, step)
    unique = _lattice_up(second + 1, k, step)
    alone = (total == 1) | ((unique < low) & (unique <= m))
    last = _lattice_down(m, k, step)
    reach = F.least(m, F.lit(min_len)) if min_len > k else m
    return F.struct(
        F.when(alone, reach).when(low <= m, low).otherwise(last).cast("int").alias("len"),
        F.when(alone, F.lit(1)).when(low <= m, _at_least(hist, low)).otherwise(_at_least(hist, last)).cast("long").alias("occ"),
    )


def end_kmers(reads: DataFrame, k: int = 14) -> DataFrame:
    """(read_id, s, kmer): the last k-mer of each read (s 0) and of its reverse complement (1)."""
    ends = reads.select("read_id", F.col("seq")).where(F.length("seq") >= k)
    both = ends.select("read_id", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.substr(normal(F.col("seq")), F.length("seq") - (k - 1), F.lit(k)).alias("kmer")), F.struct(F.lit(1).alias("s"), F.substr(revcomp(normal(F.col("seq"))), F.length("seq") - (k - 1), F.lit(k)).alias("kmer")))).alias("x"))
    return both.select("read_id", "x.s", "x.kmer")


def choose_strand(reads: DataFrame, index: DataFrame, k: int = 14) -> DataFrame:
    """(read_id, occ_fwd, occ_rev, strand): 1 if the last k-mer of the reverse complement is found, and rarer than the read's own."""
    met = end_kmers(reads, k).join(index.select("kmer", "occ"), "kmer", "left")
    occ = met.groupBy("read_id").agg(F.coalesce(F.max(F.when(F.col("s") == 0, F.col("occ"))), F.lit(0)).alias("occ_fwd"), F.coalesce(F.max(F.when(F.col("s") == 1, F.col("occ"))), F.lit(0)).alias("occ_rev"))
    turn = (F.col("occ_rev") > 0) & ((F.col("occ_fwd") == 0) | (F.col("occ_rev") < F.col("occ_fwd")))
    return occ.withColumn("strand", turn.cast("int"))


def oriented(reads: DataFrame, strands: DataFrame, swap: bool = False) -> DataFrame:
    """Reads turned to their chosen strand (with ``swap``, to the other one)."""
    turned = F.coalesce(F.col("strand"), F.lit(0)) == (0 if swap else 1)
    return reads.join(strands.select("read_id", "strand"), "read_id", "left").select("read_id", F.when(turned, revcomp(normal(F.col("seq")))).otherwise(normal(F.col("seq"))).alias("seq"), turned.cast("int").alias("turned"))


def walk(reads: DataFrame, pivot_table: DataFrame, *, k: int = 14, step: int = 1, min_len: int = 19, cap: int = 2000) -> DataFrame:
    """(read_id, qbeg, len, occ): disjoint longest matches, from the right end of each read to the left.

    After a seed the next pivot skips one base to its left, after none it moves two; a window with an
    ambiguous base is skipped to that base's left.
    """
    best = pivot_table.select("read_id", "e", longest_match(F.col("hist"), k, step).alias("best"))
    known = best.groupBy("read_id").agg(F.map_from_entries(F.collect_list(F.struct("e", "best"))).alias("at"))
    rows = reads.select("read_id", normal(F.col("seq")).alias("seq")).join(known, "read_id")
    # For every position, where a pivot that lands there is moved to: left of the last N in its window, if any.
    positions = F.sequence(F.length("seq") - 1, F.lit(0), F.lit(-1))
    start = F.struct((F.length("seq") - 1).alias("next"), F.array().cast(f"array<{SEED}>").alias("seeds"))

    def fold(acc: Column, e: Column) -> Column:
        window = F.substr(F.col("seq"), F.greatest(e - k + 2, F.lit(1)), F.least(e + 1, F.lit(k)))
        hit = F.try_element_at(F.col("at"), e)
        emits = (hit["len"] >= min_len) & ((F.lit(cap) == 0) | (hit["occ"] <= cap))
        emits = F.coalesce(emits, F.lit(False)) & (e + 1 >= min_len)
        # At the first pivot a window with an N yields nothing; later ones are moved before they are looked up.
        blocked = (F.instr(window, "N") > 0) & (e < F.length("seq") - 1)
        move = F.when(blocked, e - 1).when(emits, e - hit["len"] - 1).otherwise(e - 2)
        seeds = F.when(emits & ~blocked, F.concat(acc["seeds"], F.array(F.struct((e - hit["len"] + 1).cast("int").alias("qbeg"), hit["len"].alias("len"), hit["occ"].alias("occ"))))).otherwise(acc["seeds"])
        return F.when(acc["next"] == e, F.struct(move.cast("int").alias("next"), seeds.alias("seeds"))).otherwise(acc)

    seeds = F.aggregate(positions, start, fold, lambda acc: acc["seeds"])
    return rows.where(F.length("seq") > 0).select("read_id", F.explode(seeds).alias("s")).select("read_id", "s.qbeg", "s.len", "s.occ")


def fixed_pivots(reads: DataFrame, pivot_table: DataFrame, *, k: int = 14, step: int = 1, n: int = 3, min_len: int = 20, limit: int = 20) -> DataFrame:
    """(read_id, e, qbeg, len, occ): shortest specific matches at ``n`` pivots spread evenly from the right end."""
    length = F.length("seq")
    at = reads.where(length >= n).select("read_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (length - 1 - i * F.floor(length / n)).cast("int"))).alias("e"))
    found = at.join(pivot_table, ["read_id", "e"]).withColumn("s", shortest_specific(F.col("hist"), k, step, min_len, limit))
    return found.where((F.col("s.len") >= min_len) & (F.col("s.occ") < limit)).select("read_id", "e", (F.col("e") - F.col("s.len") + 1).alias("qbeg"), "s.len", "s.occ")


def gaps(reads: DataFrame, seeds: DataFrame, min_gap: int = 5) -> DataFrame:
    """(read_id, gap_start, gap_end): stretches between neighbouring seeds, and at both ends, of ``min_gap`` bases or more."""
    order = W.partitionBy("read_id").orderBy("qbeg", "qend")
    ends = seeds.select("read_id", "qbeg", (F.col("qbeg") + F.col("len") - 1).alias("qend"))
    between = ends.select("read_id", (F.coalesce(F.lag("qend").over(order), F.lit(-1)) + 1).alias("gap_start"), (F.col("qbeg") - 1).alias("gap_end"))
    last = ends.groupBy("read_id").agg(F.max(F.struct("qbeg", "qend")).alias("last"))
    tail = reads.select("read_id", F.length("seq").alias("n")).join(last, "read_id", "left").select("read_id", F.coalesce(F.col("last.qend") + 1, F.lit(0)).alias("gap_start"), (F.col("n") - 1).alias("gap_end"))
    return between.unionByName(tail).where(F.col("gap_end") - F.col("gap_start") + 1 >= min_gap)


def fill_gaps(gap_table: DataFrame, pivot_table: DataFrame, *, strand: int = 0, k: int = 14, step: int = 1, min_len: int = 20, limit: int = 20, gap_step: int = 4, early_exit: bool = True) -> DataFrame:
    """(read_id, gap_start, gap_end, e, qbeg, len, occ): shortest specific matches at pivots from each gap's end leftwards.

    Pivots and seeds are in the coordinates of the text whose ``pivot_table`` it is; for the other strand
    (``strand`` 1) the gap's own coordinates come in, with the read's length ``n``, and are mirrored.
    """
    size = F.col("gap_end") - F.col("gap_start") + 1
    stride = F.when(size <= min_len, max(1, gap_step // 2)).otherwise(gap_step)
    low = F.greatest(F.col("gap_start"), F.lit(min_len - 1)) if strand == 0 else F.col("gap_start")
    at = gap_table.where(F.col("gap_end") >= low).withColumn("p", F.explode(F.sequence(F.col("gap_end"), low, -stride)))
    at = at.withColumn("e", F.col("p") if strand == 0 else F.col("n") - 1 - F.col("p"))
    found = at.join(pivot_table, ["read_id", "e"]).withColumn("s", shortest_specific(F.col("hist"), k, step, min_len, limit))
    found = found.where((F.col("s.len") >= min_len) & (F.col("s.occ") < limit)).withColumns({"qbeg": F.col("e") - F.col("s.len") + 1, "len": F.col("s.len"), "occ": F.col("s.occ")})
    if early_exit:
        own_beg = F.col("qbeg") if strand == 0 else F.col("n") - 1 - F.col("e")
        covers = ((own_beg <= F.col("gap_start")) & (own_beg + F.col("len") - 1 >= F.col("gap_end"))).cast("int")
        before = W.partitionBy("read_id", "gap_start", "gap_end").orderBy(F.col("p").desc()).rowsBetween(W.unboundedPreceding, -1)
        found = found.withColumn("covers", covers).withColumn("done", F.coalesce(F.max("covers").over(before), F.lit(0))).where("done = 0")
    return found.select("read_id", "gap_start", "gap_end", "e", "qbeg", "len", "occ")


def smems(matches: DataFrame, *, min_occ: int = 1, min_len: int = 19, through: DataFrame | None = None) -> DataFrame:
    """(read_id, qbeg, len): super-maximal matches with at least ``min_occ`` places.

    For each start the ``min_occ``-th farthest end among the diagonals over it; a start counts if it reaches
    farther than every earlier one. ``through(read_id, x, s)`` asks only for matches over x with s + 1 places.
    """
    starts = matches.select("read_id", F.explode(F.sequence("qbeg", F.col("qbeg") + F.col("len") - 1)).alias("m"), (F.col("qbeg") + F.col("len") - 1).alias("end"))
    if through is not None:
        starts = starts.join(through, "read_id").where((F.col("m") <= F.col("x")) & (F.col("end") >= F.col("x")))
        keys, want = ["read_id", "x"], F.col("s") + 1
    else:
        keys, want = ["read_id"], F.lit(min_occ)
    ends = starts.groupBy(*keys, "m", "end", want.alias("want")).agg(F.count("*").alias("n"))
    ends = ends.withColumn("upto", F.sum("n").over(W.partitionBy(*keys, "m").orderBy(F.col("end").desc())))
    reach = ends.where("upto >= want").groupBy(*keys, "m").agg(F.max("end").alias("end"))
    before = W.partitionBy(*keys).orderBy("m").rowsBetween(W.unboundedPreceding, -1)
    kept = reach.withColumn("before", F.max("end").over(before)).where("before IS NULL OR end > before")
    out = kept.select("read_id", F.col("m").alias("qbeg"), (F.col("end") - F.col("m") + 1).cast("int").alias("len")).where(F.col("len") >= min_len)
    return out.distinct() if through is not None else out


def occurrences(seeds: DataFrame, matches: DataFrame) -> DataFrame:
    """``seeds(read_id, qbeg, len)`` with ``occ``: the matches that hold them."""
    m = matches.select("read_id", F.col("qbeg").alias("b"), (F.col("qbeg") + F.col("len")).alias("e"))
    met = seeds.join(m, "read_id").where((F.col("b") <= F.col("qbeg")) & (F.col("e") >= F.col("qbeg") + F.col("len")))
    return met.groupBy("read_id", "qbeg", "len").agg(F.count("*").alias("occ"))


def reseed_points(smem_table: DataFrame, *, min_seed_len: int = 19, split_factor: float = 1.5, split_width: int = 10) -> DataFrame:
    """(read_id, x, s): middles of long, rare super-maximal matches, for the second round."""
    long_ = F.col("len") >= int(min_seed_len * split_factor + 0.499)
    return smem_table.where(long_ & (F.col("occ") <= split_width)).select("read_id", F.floor((2 * F.col("qbeg") + F.col("len")) / 2).cast("int").alias("x"), F.col("occ").alias("s")).distinct()


def forward_seeds(reads: DataFrame, matches: DataFrame, *, min_len: int = 20, limit: int = 20) -> DataFrame:
    """(read_id, qbeg, len, occ): the third round, shortest matches to the right with fewer than ``limit`` places.

    From each start the match grows until it is long and rare enough; the next start follows the last base looked at.
    """
    starts = matches.select("read_id", F.explode(F.sequence("qbeg", F.col("qbeg") + F.col("len") - 1)).alias("m"), (F.col("qbeg") + F.col("len")).alias("end"))
    counted = starts.groupBy("read_id", "m", (F.col("end") - F.col("m")).alias("lce")).agg(F.count("*").alias("n"))
    counted = counted.withColumn("upto", F.sum("n").over(W.partitionBy("read_id", "m").orderBy(F.col("lce").desc())))
    hist = F.sort_array(F.collect_list(F.struct("lce", "n", "upto")), asc=False)
    per = counted.groupBy("read_id", "m").agg(hist.alias("hist"))
    need = F.greatest(F.lit(min_len), _nth(F.col("hist"), limit) + 1)
    per = per.select("read_id", "m", F.struct(need.cast("int").alias("len"), _at_least(F.col("hist"), need).cast("long").alias("occ"), _longest(F.col("hist")).cast("int").alias("most")).alias("best"))
    known = per.groupBy("read_id").agg(F.map_from_entries(F.collect_list(F.struct("m", "best"))).alias("at"))
    rows = reads.select("read_id", F.length("seq").alias("n")).join(known, "read_id")

    def fold(acc: Column, m: Column) -> Column:
        hit = F.try_element_at(F.col("at"), m)
        emits = F.coalesce((hit["occ"] > 0) & (hit["occ"] < limit), F.lit(False))
        move = m + F.when(emits, hit["len"]).otherwise(F.coalesce(hit["most"], F.lit(0)) + 1)
        seeds = F.when(emits, F.concat(acc["seeds"], F.array(F.struct(m.cast("int").alias("qbeg"), hit["len"].alias("len"), hit["occ"].alias("occ"))))).otherwise(acc["seeds"])
        return F.when(acc["next"] == m, F.struct(move.cast("int").alias("next"), seeds.alias("seeds"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{SEED}>").alias("seeds"))
    seeds = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), start, fold, lambda acc: acc["seeds"])
    return rows.where("n > 0").select("read_id", F.explode(seeds).alias("s")).select("read_id", "s.qbeg", "s.len", "s.occ")
