"""Paired reads: the distribution of insert sizes, mates found by it, and the best pair of places."""

from __future__ import annotations

import math
from dataclasses import asdict, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..options import Options
from . import dp
from .mapping import RECORD, Region, as_regions, mapq, mark, records, separate, tie

#: Bounds of the insert-size model.
MIN_COUNT, MIN_SHARE, UNIQUE, OUTLIER, MAPPING, DEVIATIONS = 10, 0.05, 0.8, 2.0, 3.0, 4.0


def orientation(strand_a: Column, strand_b: Column, a: Column, b: Column, total) -> Column:
    """(dir, dist): 0 FF, 1 FR, 2 RF, 3 RR, seen from the leftmost; ``a`` and ``b`` are doubled coordinates."""
    same = strand_a == strand_b
    other = F.when(same, b).otherwise(F.lit(2 * total - 1) - b)
    direction = F.when(same, 0).otherwise(1).bitwiseXOR(F.when(other > a, 0).otherwise(3))
    return F.struct(direction.cast("int").alias("dir"), F.abs(other - a).cast("long").alias("dist"))


def insert_stats(sizes: DataFrame, key: str = "dir", value: str = "dist") -> DataFrame:
    """(key, n, p25, p50, p75, avg, std, low, high, failed) of whole numbers ``value``.

    Percentiles are elements of the sorted sizes, at int(p * n + .499). Sizes are counted first, so the
    sorted list is as long as there are different sizes, not as there are pairs.
    """
    counted = sizes.groupBy(key, value).agg(F.count("*").alias("c"))
    order = W.partitionBy(key).orderBy(value)
    ranked = counted.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(W.partitionBy(key)))
    pick = lambda p: F.min(F.when(F.col("upto") > (F.lit(p) * F.col("n") + 0.499).cast("long"), F.col(value)))
    p = ranked.groupBy(key).agg(F.max("n").alias("n"), pick(0.25).alias("p25"), pick(0.50).alias("p50"), pick(0.75).alias("p75"))
    spread = F.col("p75") - F.col("p25")
    p = p.withColumn("lo", F.greatest(F.lit(1), (F.col("p25") - F.lit(OUTLIER) * spread + 0.499).cast("long"))).withColumn("hi", (F.col("p75") + F.lit(OUTLIER) * spread + 0.499).cast("long"))
    inner = counted.join(p, key).where((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
    mean = inner.groupBy(key).agg((F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("avg"))
    dev = inner.join(mean, key).groupBy(key).agg(F.first("avg").alias("avg"), F.sqrt(F.sum((F.col(value) - F.col("avg")) * (F.col(value) - F.col("avg")) * F.col("c")) / F.sum("c")).alias("std"))
    out = p.join(dev, key)
    low, high = (F.col("p25") - F.lit(MAPPING) * spread + 0.499).cast("long"), (F.col("p75") + F.lit(MAPPING) * spread + 0.499).cast("long")
    low = F.when(low > F.col("avg") - DEVIATIONS * F.col("std"), (F.col("avg") - DEVIATIONS * F.col("std") + 0.499).cast("long")).otherwise(low)
    high = F.when(high < F.col("avg") + DEVIATIONS * F.col("std"), (F.col("avg") + DEVIATIONS * F.col("std") + 0.499).cast("long")).otherwise(high)
    commonest = F.max("n").over(W.partitionBy(F.lit(0)))  # a row for each orientation
    failed = (F.col("n") < MIN_COUNT) | (F.col("n") < commonest * MIN_SHARE)
    return out.select(key, "n", "p25", "p50", "p75", "avg", "std", F.greatest(F.lit(1), low).alias("low"), high.alias("high"), failed.alias("failed"))


def insert_sizes(regions: DataFrame, total: int, o: Options) -> DataFrame:
    """(dir, dist) of pairs whose best places are unique on both sides and on one contig; ``regions`` have pair_id and mate."""
    best = W.partitionBy("pair_id", "mate").orderBy(F.col("score").desc(), "rb", "qb")
    ranked = regions.withColumn("nth", F.row_number().over(best))
    top = ranked.where("nth = 1").select("pair_id", "mate", "rid", "strand", "rb", "score", "qb", "qe")
    rest = ranked.where("nth > 1").select("pair_id", "mate", F.col("score").alias("s2"), F.col("qb").alias("b2"), F.col("qe").alias("e2"))
    shared = F.least("e2", "qe") - F.greatest("b2", "qb")
    over = (shared > 0) & (shared >= o.mask_level * F.least(F.col("e2") - F.col("b2"), F.col("qe") - F.col("qb")))
    sub = top.join(rest, ["pair_id", "mate"], "left").groupBy(*top.columns).agg(F.coalesce(F.max(F.when(over, F.col("s2"))), F.lit(o.min_seed_len * o.match)).alias("second"))
    unique = sub.where(F.col("second") <= UNIQUE * F.col("score"))
    a, b = unique.where("mate = 0").alias("a"), unique.where("mate = 1").alias("b")
    both = a.join(b, F.col("a.pair_id") == F.col("b.pair_id")).where("a.rid = b.rid")
    x = both.select(orientation(F.col("a.strand"), F.col("b.strand"), F.col("a.rb"), F.col("b.rb"), total).alias("x"))
    return x.select("x.dir", "x.dist").where((F.col("dist") > 0) & (F.col("dist") <= o.max_ins))


def stats_list(stats: DataFrame) -> list[dict]:
    """The four rows, by orientation; missing ones have failed."""
    out = [{"failed": True, "avg": 0.0, "std": 1.0, "low": 0, "high": 0} for _ in range(4)]
    for r in stats.collect():  # four rows at most
        out[r["dir"]] = {**{k: r[k] for k in ("failed", "avg", "low", "high")}, "std": max(r["std"], 1e-9)}
    return out


def given_stats(avg: float, std: float | None = None, high: int | None = None, low: int | None = None) -> list[dict]:
    """A model from given numbers, for pairs that face each other."""
    out = [{"failed": True, "avg": 0.0, "std": 1.0, "low": 0, "high": 0} for _ in range(4)]
    std = avg * 0.1 if std is None else std
    out[1] = {"failed": False, "avg": avg, "std": std, "high": int(avg + 4 * std + 0.499) if high is None else high, "low": max(1, int(avg - 4 * std + 0.499)) if low is None else low}
    return out


def direction(strand_a: int, strand_b: int, a: int, b: int, total: int) -> tuple[int, int]:
    other = b if strand_a == strand_b else 2 * total - 1 - b
    return (0 if strand_a == strand_b else 1) ^ (0 if other > a else 3), abs(other - a)


def rescue_windows(regions: DataFrame, lengths: DataFrame, model: list[dict], total: int, o: Options) -> DataFrame:
    """Where the mate of each good hit should lie: (pair_id, mate, rid, strand, size, base, is_alt, beg, end), on the mate's strand.

    Hits within ``unpaired`` of the best count, ``max_rescue`` at most; an orientation that a hit of the mate already
    satisfies is not asked for.
    """
    usable = [(d, m) for d, m in enumerate(model) if not m["failed"]]
    order = W.partitionBy("pair_id", "mate").orderBy(F.col("score").desc(), "rb", "qb")
    good = regions.withColumn("nth", F.row_number().over(order)).withColumn("top", F.max("score").over(W.partitionBy("pair_id", "mate"))).where((F.col("score") >= F.col("top") - o.unpaired) & (F.col("nth") <= o.max_rescue))
    asks = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(int(m["low"])).alias("low"), F.lit(int(m["high"])).alias("high")) for d, m in usable]) if usable else F.array().cast("array<struct<d:int,low:int,high:int>>")
    g = good.select("pair_id", "mate", "nth", "rid", "strand", "base", "size", "is_alt", "rb", F.explode(asks).alias("m"))
    other = regions.select("pair_id", (1 - F.col("mate")).alias("mate"), F.col("rid").alias("rid2"), F.col("strand").alias("strand2"), F.col("rb").alias("rb2"))
    x = orientation(F.col("strand"), F.col("strand2"), F.col("rb"), F.col("rb2"), total)
    met = g.join(other, ["pair_id", "mate"], "left").withColumn("x", F.when(F.col("rid") == F.col("rid2"), x))
    fits = (F.col("x.dir") == F.col("m.d")) & (F.col("x.dist") >= F.col("m.low")) & (F.col("x.dist") <= F.col("m.high"))
    open_ = met.groupBy(*g.columns).agg(F.coalesce(F.max(fits.cast("int")), F.lit(0)).alias("has")).where("has = 0")
    open_ = open_.select("pair_id", (1 - F.col("mate")).alias("mate"), "rid", "strand", "base", "size", "is_alt", "rb", "m").join(lengths, ["pair_id", "mate"])
    turned = (F.col("m.d").isin(1, 2)).cast("int")  # the mate lies on the other strand
    larger = F.col("m.d").isin(0, 1)  # and further along in this strand's direction
    near, far = F.when(larger, F.col("rb") + F.col("m.low")).otherwise(F.col("rb") - F.col("m.high")), F.when(larger, F.col("rb") + F.col("m.high")).otherwise(F.col("rb") - F.col("m.low"))
    beg = F.when(turned == 1, near - F.col("n")).otherwise(near) - F.col("base")
    end = F.when(turned == 1, far).otherwise(far + F.col("n")) - F.col("base")
    beg, end = F.greatest(beg, F.lit(0)), F.least(end, F.col("size"))
    strand = F.col("strand").bitwiseXOR(turned)
    out = open_.select("pair_id", "mate", "rid", strand.cast("int").alias("strand"), "size", "is_alt", F.when(turned == 1, F.lit(2 * total) - F.col("base") - F.col("size")).otherwise(F.col("base")).alias("base"), F.when(turned == 1, F.col("size") - end).otherwise(beg).alias("beg"), F.when(turned == 1, F.col("size") - beg).otherwise(end).alias("end"))
    return out.where(F.col("end") - F.col("beg") >= o.min_seed_len).distinct()


def rescue(windows: DataFrame, mates: DataFrame, o: Options) -> DataFrame:
    """Local alignments of mates in their windows, as regions: (pair_id, mate, <Region>)."""
    names = [f.name for f in fields(Region)]
    joined = windows.join(mates.select("pair_id", "mate", "seq"), ["pair_id", "mate"])

    def run(parts):
        for part in parts:
            out = []
            for r in part.itertuples():
                score, qb, qe, tb, te, second = dp.local(dp.codes(r.seq), dp.codes(r.target), o, o.min_seed_len * o.match)
                if score >= o.min_seed_len * o.match and qe > qb:
                    rb = r.base + r.beg + tb
                    region = Region(r.rid, r.strand, r.base, r.size, rb, rb + te - tb, qb, qe, score, score, o.band, min(qe - qb, te - tb) >> 1, 0.0, bool(r.is_alt), r.target[tb:te], csub=second)
                    out.append({"pair_id": r.pair_id, "mate": r.mate, **asdict(region)})
            yield pd.DataFrame(out, columns=["pair_id", "mate", *names])

    from .mapping import COLUMNS

    return joined.mapInPandas(run, f"pair_id bigint, mate int, {COLUMNS}")


def best_pair(first: list[Region], second: list[Region], model: list[dict], pair_id: int, total: int, o: Options) -> tuple[int, int, int, int, int] | None:
    """(score, second best score, how many come near it, place of the first read, of its mate) of the best pair within bounds."""
    found = []
    for i, a in enumerate(first):
        for j, b in enumerate(second):
            if a.rid != b.rid or a.secondary == -2 or b.secondary == -2:
                continue
            d, dist = direction(a.strand, b.strand, a.rb, b.rb, total)
            m = model[d]
            if m["failed"] or not m["low"] <= dist <= m["high"]:
                continue
            z = abs(dist - m["avg"]) / m["std"]
            chance = 2 * math.erfc(z / math.sqrt(2))
            score = int(a.score + b.score + 0.721 * math.log(chance) * o.match + 0.499) if chance > 0 else 0
            found.append((max(score, 0), tie(pair_id, i << 16 | j) & 0xFFFFFFFF, i, j))
    if not found:
        return None
    found.sort()
    near = max(o.match + o.mismatch, o.o_del + o.e_del, o.o_ins + o.e_ins)
    score, _, i, j = found[-1]
    sub = found[-2][0] if len(found) > 1 else 0
    return score, sub, sum(sub - x[0] <= near for x in found[:-1]) - (len(found) > 1), i, j


def paired_end(regions: DataFrame, mates: DataFrame, model: list[dict], total: int, o: Options) -> DataFrame:
    """Records of both mates, with what each needs of the other: RECORD, pair_id, mate, and m_* of the mate's first record."""
    whole = mates.groupBy("pair_id").agg(F.max(F.when(F.col("mate") == 0, F.col("seq"))).alias("seq0"), F.max(F.when(F.col("mate") == 1, F.col("seq"))).alias("seq1"))
    joined = regions.join(whole, "pair_id")
    columns = [f.split(" ")[0] for f in RECORD.replace("len:int,op", "len:int;op").split(", ")]
    extra = ["pair_id", "mate", "proper"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        pair = int(part["pair_id"].iloc[0])
        seqs = [dp.codes(part[f"seq{i}"].iloc[0]) for i in (0, 1)]
        ranked = [mark(separate(as_regions(part[part["mate"] == i]), seqs[i], o), 2 * pair + i, o) for i in (0, 1)]
        main = [[r for r in x if not r.is_alt] for x in ranked]
        proper, quality = False, [{}, {}]
        found = best_pair(*main, model, pair, total, o) if o.pairing and all(main) else None
        if found:
            score, sub, n_sub, i, j = found
            alone = main[0][0].score + main[1][0].score - o.unpaired
            if score > alone:
                proper = True
                sub = max(sub, alone)
                q_pair = min(60, max(0, int(6.02 * (score - sub) / o.match + 0.499) - (int(4.343 * math.log(n_sub + 1) + 0.499) if n_sub > 0 else 0)))
                q_pair = int(q_pair * (1.0 - 0.5 * (main[0][0].frac_rep + main[1][0].frac_rep)) + 0.499)
                for side, k in ((0, i), (1, j)):
                    chosen = main[side][k]
                    if chosen.secondary >= 0:
                        chosen.sub, chosen.secondary = ranked[side][chosen.secondary].score, -2
                    q = mapq(chosen, o)
                    q = max(q, min(q_pair, q + 40))
                    if chosen.csub:
                        q = min(q, int(6.02 * (chosen.score - chosen.csub) / o.match + 0.499))
                    at = ranked[side].index(chosen)
                    if chosen.secondary == -2:
                        old = next(x for x in range(len(ranked[side])) if ranked[side][x].secondary == -1)
                        chosen.secondary = -1
                        ranked[side][old].secondary = at
                        for r in ranked[side]:
                            if r is not chosen and r is not ranked[side][old] and r.secondary == old:
                                r.secondary = at
                        order = [at, *(x for x in range(len(ranked[side])) if x != at)]
                        place = {x: y for y, x in enumerate(order)}
                        ranked[side] = [ranked[side][x] for x in order]
                        for r in ranked[side]:
                            r.secondary = place.get(r.secondary, r.secondary)
                        at = 0
                    quality[side][at] = q
            else:
                d, dist = direction(main[0][0].strand, main[1][0].strand, main[0][0].rb, main[1][0].rb, total)
                m = model[d]
                proper = main[0][0].rid == main[1][0].rid and not m["failed"] and m["low"] <= dist <= m["high"]
        out = []
        for side in (0, 1):
            for r in records(2 * pair + side, seqs[side], ranked[side], o, quality=quality[side]):
                out.append({**r, "pair_id": pair, "mate": side, "proper": proper})
        return pd.DataFrame(out, columns=[*columns, *extra])

    made = joined.groupBy("pair_id").applyInPandas(run, f"{RECORD}, pair_id bigint, mate int, proper boolean")
    return made


def with_mates(made: DataFrame, mates: DataFrame) -> DataFrame:
    """Records of all mates, unmapped ones too, with flags of pairs and m_* of the other mate's first record."""
    base = mates.select("pair_id", "mate").join(made, ["pair_id", "mate"], "left").withColumn("read_id", F.coalesce("read_id", 2 * F.col("pair_id") + F.col("mate"))).withColumn("nth", F.coalesce("nth", F.lit(0)))
    other = made.where("nth = 0").select("pair_id", (1 - F.col("mate")).alias("mate"), F.col("rid").alias("m_rid"), F.col("pos").alias("m_pos"), (F.col("strand") == 1).alias("m_rev"), F.col("cigar").alias("m_cigar"), F.col("proper").alias("m_proper"))
    met = base.join(other, ["pair_id", "mate"], "left")
    bit = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0))
    gone, lost = F.col("rid").isNull(), F.col("m_rid").isNull()
    flag = F.coalesce("flag", F.lit(4)) + 1 + bit(~gone & ~lost & F.coalesce("proper", F.lit(False)), 2) + bit(lost, 8) + bit(F.coalesce("m_rev", F.lit(False)) | (lost & (F.col("strand") == 1)), 0x20) + bit(gone & F.coalesce("m_rev", F.lit(False)), 0x10) + F.when(F.col("mate") == 0, 0x40).otherwise(0x80)
    return met.withColumn("flag", flag.cast("int"))
