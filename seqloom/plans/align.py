"""Whole runs: reads against a reference, single or paired, from tables to tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encode
from ..functions.storage import cut
from ..operators import chaining, emit, hits, mapping, pairing, refindex, seeding
from ..options import Options


@dataclass
class Index:
    """What a run needs of a reference; all are tables, so a stored index is a folder of Parquet."""

    contigs: DataFrame
    chunks: DataFrame
    positions: DataFrame
    total: int
    kmer: int

    def save(self, path: str) -> None:
        """Contigs, chunks and k-mer places, the latter clustered by k-mer, with a row of numbers to check on loading."""
        spark = self.contigs.sparkSession
        self.contigs.write.mode("overwrite").parquet(f"{path}/contigs")
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.positions.repartition("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/positions")
        spark.createDataFrame([(1, self.total, self.kmer)], "version int, total bigint, kmer int").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> Index:
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta is None or meta["version"] != 1:
            raise ValueError(f"{path} is no index of this version")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return Index(read("contigs"), read("chunks"), read("positions"), meta["total"], meta["kmer"])


def build_index(seqs: DataFrame, kmer: int = 14, alt: DataFrame | None = None) -> Index:
    """``seqs(rid, name, seq)`` -> an index of both strands."""
    table = refindex.contigs(seqs)
    table = cut(refindex.mark_alt(table, alt) if alt is not None else table.withColumn("is_alt", F.lit(False)))
    chunks = cut(refindex.ref_chunks(seqs, kmer))
    total = table.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("n")).first()["n"]
    return Index(table, chunks, refindex.kmer_positions(chunks, kmer), total, kmer)


def near(reads: DataFrame, index: Index) -> DataFrame:
    """The index's places of k-mers that the reads have, on either strand: one pass over the index serves all of a run's steps."""
    both = reads.select("read_id", "seq").unionByName(reads.select("read_id", encode.revcomp(F.col("seq")).alias("seq")))
    return cut(index.positions.join(seeding.read_kmers(both, index.kmer).select("kmer").distinct(), "kmer", "left_semi"))


def smem_seeds(reads: DataFrame, matches: DataFrame, o: Options) -> DataFrame:
    """Seeds of three rounds: super-maximal matches, rarer ones through the middles of long ones, and short rare ones."""
    first = cut(seeding.occurrences(seeding.smems(matches, min_len=o.min_seed_len), matches))
    points = seeding.reseed_points(first, min_seed_len=o.min_seed_len, split_factor=o.split_factor, split_width=o.split_width)
    second = seeding.occurrences(seeding.smems(matches, min_len=o.min_seed_len, through=points), matches)
    out = first.unionByName(second)
    if o.max_mem_intv > 0:
        out = out.unionByName(seeding.forward_seeds(reads, matches, min_len=o.min_seed_len + 1, limit=o.max_mem_intv).select("read_id", "qbeg", "len", "occ"))
    return out


def pivot_seeds(reads: DataFrame, index: Index, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds by pivots, and the matches and reads (turned to the chosen strand) that they refer to.

    A read is walked on its chosen strand; stretches without a seed are filled from both strands, or pivots at fixed
    places take the walk's place for that.
    """
    k = index.kmer
    positions = near(reads, index)
    # Only the k-mers at reads' ends are counted.
    ends = reads.where(F.length("seq") >= k).select(F.explode(F.array(F.substr("seq", F.length("seq") - (k - 1), F.lit(k)), F.substr(encode.revcomp(F.col("seq")), F.length("seq") - (k - 1), F.lit(k)))).alias("kmer")).distinct()
    strands = seeding.choose_strand(reads, positions.join(ends, "kmer", "left_semi").groupBy("kmer").agg(F.count("*").alias("occ")), k) if o.choose_strand else reads.select("read_id", F.lit(0).alias("strand"))
    strands = cut(strands)
    turned = cut(seeding.oriented(reads, strands))
    matches = cut(seeding.maximal_matches(turned, positions, k))
    table = cut(seeding.pivots(matches, k))
    walked = cut(seeding.walk(turned, table, k=k, step=o.step, min_len=o.min_seed_len, cap=o.seed_cap))
    short = {"k": k, "step": o.step, "min_len": o.min_seed_len + 1, "limit": o.max_mem_intv}
    if o.use_fixed_pivots:
        more = seeding.fixed_pivots(turned, table, n=o.fixed_pivots, **short)
        return walked.unionByName(more.select("read_id", "qbeg", "len", "occ")), matches, turned
    open_ = cut(seeding.gaps(turned, walked, o.min_gap))
    fill = {**short, "gap_step": o.gap_step, "early_exit": o.gap_early_exit}
    filled = cut(seeding.fill_gaps(open_, table, **fill))
    covered = filled.where("qbeg <= gap_start AND qbeg + len - 1 >= gap_end").select("read_id", "gap_start", "gap_end").distinct()
    again = open_ if o.both_strands else open_.join(covered, ["read_id", "gap_start", "gap_end"], "left_anti")
    # The other strand: the reference holds both, so its pivots are those of the reverse complement of the turned read.
    back = seeding.oriented(reads, strands, swap=True)
    back_table = seeding.pivots(seeding.maximal_matches(back.join(again.select("read_id").distinct(), "read_id", "left_semi"), positions, k), k)
    lengths = reads.select("read_id", F.length("seq").alias("n"))
    other = seeding.fill_gaps(again.join(lengths, "read_id"), back_table, strand=1, **fill)
    other = other.join(lengths, "read_id").withColumn("qbeg", F.col("n") - F.col("qbeg") - F.col("len"))
    out = walked.unionByName(filled.select("read_id", "qbeg", "len", "occ")).unionByName(other.select("read_id", "qbeg", "len", "occ"))
    return out.distinct(), matches, turned


def regions(reads: DataFrame, index: Index, o: Options, seeder: str = "pivot") -> DataFrame:
    """(read_id, <Region>): extended, de-overlapped places of ``reads(read_id, seq)``, on the read's own strand."""
    if seeder == "pivot":
        seeds, matches, turned = pivot_seeds(reads, index, o)
        # Places as the read itself has them: a turned read's match is the mirrored match of the read.
        n = F.length("seq")
        flip = turned.select("read_id", "turned", n.alias("n"))
        places = hits.expand(seeds, matches, o.max_occ).join(flip, "read_id").join(index.contigs.select("rid", F.col("len").alias("size")), "rid")
        places = places.select("read_id", F.when(F.col("turned") == 1, F.col("n") - F.col("qbeg") - F.col("len")).otherwise(F.col("qbeg")).cast("int").alias("qbeg"), "len", "occ", "rid", F.col("strand").bitwiseXOR(F.col("turned")).alias("strand"), F.when(F.col("turned") == 1, F.col("size") - F.col("pos") - F.col("len")).otherwise(F.col("pos")).alias("pos"))
    elif seeder == "smem":
        matches = cut(seeding.maximal_matches(reads, near(reads, index), index.kmer))
        places = hits.expand(smem_seeds(reads, matches, o), matches, o.max_occ)
    else:
        raise ValueError(f"there is no seeder {seeder}")
    full = hits.doubled(cut(places), index.contigs, index.total, reads)
    chains = cut(chaining.chains_of_reads(full, o))
    wanted = chains.select("read_id", "chain_no", "rid", "strand", "size", (F.col("win_beg") - F.col("base")).alias("beg"), (F.col("win_end") - F.col("base")).alias("end"))
    text = hits.windows(wanted, index.chunks).select("read_id", "chain_no", "target")
    return mapping.regions_of_reads(chains.join(text, ["read_id", "chain_no"]), reads, o)


def align(reads: DataFrame, index: Index, o: Options | None = None, seeder: str = "pivot") -> DataFrame:
    """Records of ``reads(read_id, seq)``; reads that fit nowhere have none."""
    o = o or Options()
    return mapping.single_end(cut(regions(reads, index, o, seeder)), reads, o)


def align_pairs(mates: DataFrame, index: Index, o: Options | None = None, seeder: str = "pivot", model: list[dict] | None = None) -> DataFrame:
    """Records of ``mates(pair_id, mate, name, seq)``, unmapped ones too; names that differ within a pair are an error."""
    o = o or Options()
    names = mates.groupBy("pair_id").agg(F.count_distinct("name").alias("n"))
    ok = F.when(F.col("n") > 1, F.raise_error(F.lit("the reads of a pair have different names"))).otherwise(F.lit(True))
    mates = mates.join(names.where(ok).select("pair_id"), "pair_id").withColumn("read_id", 2 * F.col("pair_id") + F.col("mate"))
    mates = cut(mates)
    found = regions(mates.select("read_id", "seq"), index, o, seeder)
    found = cut(found).withColumn("pair_id", F.floor(F.col("read_id") / 2)).withColumn("mate", (F.col("read_id") % 2).cast("int")).drop("read_id")
    model = model or pairing.stats_list(pairing.insert_stats(pairing.insert_sizes(found, index.total, o)))
    if o.rescue:
        lengths = mates.select("pair_id", "mate", F.length("seq").alias("n"))
        windows = pairing.rescue_windows(found, lengths, model, index.total, o)
        found = found.unionByName(pairing.rescue(hits.windows(windows, index.chunks), mates, o))
    return pairing.with_mates(cut(pairing.paired_end(found, mates, model, index.total, o)), mates)


def sam(records: DataFrame, reads: DataFrame, index: Index, o: Options | None = None, mates: bool = False) -> DataFrame:
    """(read_id, nth, line) for ``reads(read_id, name, seq, qual)``; with ``mates`` for the records of ``align_pairs``."""
    return emit.lines(records, reads, index.contigs, o or Options(), mates)


def sam_pairs(mates: DataFrame, index: Index, o: Options | None = None, **how) -> DataFrame:
    """(read_id, nth, line) for ``mates(pair_id, mate, name, seq, qual)``: read 2 i and 2 i + 1 are the mates of pair i."""
    reads = mates.withColumn("read_id", 2 * F.col("pair_id") + F.col("mate"))
    return sam(align_pairs(mates, index, o, **how), reads, index, o, mates=True)
