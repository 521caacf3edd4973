"""Sequence operators on small generated genomes."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from seqloom.functions import encode
from seqloom.operators import chaining, dp, emit, evaluate, filters, hits, mapping, pairing, refindex, seeding
from seqloom.operators.chaining import Seed
from seqloom.options import Options
from seqloom.plans import align as plans
from seqloom.sources import readers

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.fixture(scope="module")
def genome():
    repeat = dna(300, 9)
    return [("c0", dna(1500, 1) + repeat + dna(700, 2)), ("c1", dna(900, 3) + "N" * 20 + dna(900, 4) + repeat), ("c2", dna(1200, 5))]


@pytest.fixture(scope="module")
def index(spark, genome):
    seqs = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(genome)], "rid bigint, name string, seq string")
    return plans.build_index(seqs)


def test_encodings(spark):
    df = spark.createDataFrame([("ACGTN",), ("",), (None,), ("acgg",)], "s string")
    got = [tuple(r) for r in df.select(encode.revcomp(F.col("s")), encode.clean(F.col("s")), encode.pair_codes(encode.clean(F.col("s")), 0)).collect()]
    assert got[0] == ("NACGT", "ACGTA", "1B") and got[1] == ("", "", "") and got[2][:2] == (None, None) and got[3][:2] == ("ccgt", "ACGG")


def test_filters(spark):
    df = spark.createDataFrame([(0, "ACGT"), (1, "ACNT"), (2, "ACRT"), (3, None), (4, "")], "ord bigint, seq string")
    assert [r.ord for r in filters.clean_reads(df).orderBy("ord").collect()] == [0, 4]
    assert {r.base: r.n for r in filters.dropped_base_tally(df).collect()} == {"N": 1, "R": 1}
    pairs = filters.pair_up(df.where("ord < 2"), df.where("ord < 2"))
    assert filters.pair_counts(pairs).first().asDict() == {"n_pairs": 2, "n_kept": 1, "only_first": 0, "only_second": 0, "both": 1}
    with pytest.raises(Exception, match="different numbers"):
        filters.pair_up(df.where("ord < 2"), df.where("ord < 1")).collect()


def test_reference_tables(spark, genome, index):
    seqs = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(genome)], "rid bigint, name string, seq string")
    assert [(r.start, r.len, r.amb) for r in refindex.holes(seqs).collect()] == [(900, 20, "N")]
    assert [(r.offset, r.len) for r in index.contigs.orderBy("rid").collect()] == [(0, 2500), (2500, 2120), (4620, 1200)]
    for chunk in index.chunks.where("strand = 1").limit(5).collect():
        text = rc(genome[chunk.rid][1].replace("N", "A"))
        assert text[chunk.start : chunk.start + len(chunk.bases)] == chunk.bases
    total = refindex.validate(index.positions.groupBy("kmer").agg(F.count("*").alias("occ"))).first()
    assert total.n_unequal == 0 and total.n_places == 2 * sum(len(s) - 13 for _, s in genome)


def brute_lce(text, read, e):
    out = []
    for x in text:
        for p in range(len(x)):
            n = 0
            while n <= e and p - n >= 0 and x[p - n] == read[e - n]:
                n += 1
            if n >= 14:
                out.append(n)
    return sorted(out, reverse=True)


def test_pivots_and_rules_by_brute_force(spark):
    contig = "".join(random.Random(3).choices("AC", k=300))
    read = contig[40:90] + "G" + contig[10:40]
    seqs = spark.createDataFrame([(0, "c", contig)], "rid bigint, name string, seq string")
    reads = spark.createDataFrame([(0, read)], "read_id bigint, seq string")
    positions = refindex.kmer_positions(refindex.ref_chunks(seqs))
    table = seeding.pivots(seeding.maximal_matches(reads, positions))
    rows = table.select("e", "hist", seeding.longest_match(F.col("hist")).alias("a"), seeding.shortest_specific(F.col("hist"), min_len=16, limit=3).alias("c")).collect()
    text = [contig, rc(contig)]
    assert {r.e for r in rows} == {e for e in range(len(read)) if brute_lce(text, read, e)}
    for r in rows:
        lces = brute_lce(text, read, r.e)
        assert [x.lce for x in r.hist for _ in range(x.n)] == lces
        assert (r.a.len, r.a.occ) == (lces[0], lces.count(lces[0]))
        # Grown one base at a time from the k-mer: stop once long enough and rare enough, or alone and long enough.
        n = 15
        while sum(x >= n for x in lces) >= 1 and not (n >= 16 and sum(x >= n for x in lces) < 3):
            n += 1
        if len(lces) == 1:
            n = min(lces[0], 16)
        want = (n, sum(x >= n for x in lces)) if any(x >= n for x in lces) else (lces[0], lces.count(lces[0]))
        if not (r.c.occ == 1 and want[1] == 1):
            assert (r.c.len, r.c.occ) == want


def test_walk_skips_ambiguous_bases(spark, genome, index):
    read = genome[0][1][100:160] + "N" + genome[0][1][161:230]
    reads = spark.createDataFrame([(0, read), (1, "ACGT"), (2, "")], "read_id bigint, seq string")
    table = seeding.pivots(seeding.maximal_matches(reads, index.positions))
    assert [(r.qbeg, r.len) for r in seeding.walk(reads, table).orderBy("qbeg").collect()] == [(0, 60), (61, 69)]
    gaps = seeding.gaps(reads, seeding.walk(reads, table)).orderBy("read_id").collect()
    assert [(r.read_id, r.gap_start, r.gap_end) for r in gaps] == []


def test_positions_and_sampling(spark, index):
    places = spark.createDataFrame([(0, 10), (2495, 10), (2500, 10)], "pos bigint, len int")
    assert [(r.rid, r.contig_pos) for r in hits.pos_to_contig(places, index.contigs, 1000).orderBy("pos").collect()] == [(0, 0), (-1, 2495), (1, 0)]
    matches = spark.createDataFrame([(0, 0, 0, 0, 7 * i, 30) for i in range(10)], "read_id bigint, rid bigint, strand int, qbeg int, rbeg bigint, len int")
    seeds = spark.createDataFrame([(0, 5, 20)], "read_id bigint, qbeg int, len int")
    assert [(r.pos, r.occ) for r in hits.expand(seeds, matches, 3).orderBy("pos").collect()] == [(5, 3), (26, 3), (47, 3)]


def test_chains():
    o = Options()
    hit = lambda q, r, n: (Seed(q, r, n, 1), 0, 0, 0, 10000, False)
    chains = chaining.chain([hit(0, 100, 30), hit(40, 142, 30), hit(10, 110, 10), hit(0, 5000, 25)], o)
    assert [(len(c.seeds), c.weight) for c in chains] == [(2, 60), (1, 25)]
    assert [(c.kept, c.weight) for c in chaining.select_chains(chains, o)] == [(3, 60), (1, 25)]
    assert chaining.covered([(0, 10), (5, 10), (30, 5)]) == 20


def test_chains_are_selected_as_the_rule_says():
    """Against the rule applied pair by pair."""
    rng = random.Random(6)
    for trial in range(200):
        o = replace(Options(), max_chain_extend=rng.choice([0, 1, 3, 1 << 30]), min_chain_weight=rng.choice([0, 12]))
        chains = []
        for _ in range(rng.randrange(8)):
            beg, n = rng.randrange(100), rng.randrange(5, 120)
            chains.append(chaining.Chain(0, 0, 0, 10**6, [Seed(beg, 500 + beg, n, 1)], rng.random() < 0.3, weight=n))
        order = sorted((c for c in chains if c.weight >= o.min_chain_weight), key=lambda c: -c.weight)
        ends = [(c.beg, c.end) for c in order]
        want, firsts = {}, {}
        for i, c in enumerate(order):
            want[i] = 3
            for j in range(i):
                common, least = min(ends[i][1], ends[j][1]) - max(ends[i][0], ends[j][0]), min(ends[i][1] - ends[i][0], ends[j][1] - ends[j][0])
                if want[j] and common > 0 and common >= least / 2 and not (order[j].is_alt and not c.is_alt):
                    firsts.setdefault(j, i)
                    want[i] = 2
                    if 2 * c.weight < order[j].weight and order[j].weight - c.weight >= 38:
                        want[i] = 0
                        break
        want |= {i: 1 for i in firsts.values()}
        got = chaining.select_chains(chains, o)
        extra = [i for i in want if want[i] in (1, 2)][: o.max_chain_extend]
        assert [id(c) for c in got] == [id(order[i]) for i in sorted(want) if want[i] == 3 or i in extra]


def test_regions_that_overlap_or_follow_each_other():
    text = dna(400, 3)
    read = text[50:150] + text[154:254]  # four bases of the reference are missing
    o = Options()
    of = lambda rb, re, qb, qe, score: mapping.Region(0, 0, 0, 400, rb, re, qb, qe, score, score, 0, score, 0.0, False, text[rb:re])
    one, other = of(50, 150, 0, 100, 100), of(154, 254, 100, 200, 100)
    seq = dp.codes(read)
    assert [(r.rb, r.re) for r in mapping.separate([one, other], seq, o)] == [(50, 150), (154, 254)]  # the gap's text isn't known
    got = mapping.separate([one, other], seq, o, [(0, 0, 40, text[40:300])])
    assert [(r.rb, r.re, r.qb, r.qe, r.target, r.score) for r in got] == [(50, 254, 0, 200, text[50:254], 190)]
    assert len(mapping.separate([one, of(174, 274, 100, 200, 100)], seq, o, [(0, 0, 40, text[40:300])])) == 2  # too far apart
    inner = of(51, 150, 1, 100, 40)
    assert mapping.separate([one, inner], seq, o) == [one] and mapping.separate([inner, one, of(50, 150, 0, 100, 100)], seq, o) == [one]
    assert mapping.tie(0, 0) != mapping.tie(0, 1) and 0 <= mapping.tie(2**63, 5) < 2**64


@pytest.mark.parametrize("seeder", ["pivot", "smem"])
def test_simulated_reads(spark, genome, index, seeder):
    rng = random.Random(8)
    rows, truth = [], {}
    for i in range(24):
        rid = i % 3
        text = genome[rid][1]
        pos = rng.randrange(0, 600)
        read = list(text[pos : pos + 150])
        for _ in range(i % 3):
            p = rng.randrange(150)
            read[p] = {"A": "C", "C": "G", "G": "T", "T": "A"}[read[p]]
        if i % 5 == 4:
            del read[70:73]
        read = "".join(read)
        truth[i] = (rid, pos, i % 2)
        rows.append((i, rc(read) if i % 2 else read))
    rows.append((99, dna(150, 77)))
    reads = spark.createDataFrame(rows, "read_id bigint, seq string")
    got = {r.read_id: r for r in plans.align(reads, index, seeder=seeder).where("nth = 0").collect()}
    assert set(got) == set(truth)
    for i, (rid, pos, back) in truth.items():
        r = got[i]
        assert (r.rid, r.pos, r.strand) == (rid, pos, back), (i, r)
        assert sum(x.len for x in r.cigar if x.op in "MIS") == len(dict(rows)[i]) and r.nm <= 2 + 3 * (i % 5 == 4) and r.mapq > 30


def test_pairs(spark, genome, index):
    rng = random.Random(4)
    rows = []
    for i in range(30):
        text = genome[0][1][:1500] if i % 2 else genome[2][1]
        size = 350 + rng.randrange(-50, 50)
        pos = rng.randrange(0, len(text) - size)
        rows += [(i, 0, f"p{i}", text[pos : pos + 100]), (i, 1, f"p{i}", rc(text[pos + size - 100 : pos + size]))]
    rows[1] = (0, 1, "p0", dna(100, 55))
    mates = spark.createDataFrame(rows, "pair_id bigint, mate int, name string, seq string")
    got = plans.align_pairs(mates, index).collect()
    assert len(got) == 60
    flags = {(r.pair_id, r.mate): r.flag for r in got}
    assert flags[0, 1] & 0x4 and flags[0, 0] & 0x8
    assert all(f & 0x2 for (p, _), f in flags.items() if p) and all(f & (0x80 if m else 0x40) for (_, m), f in flags.items())


def test_paired_sam(spark, genome, index):
    rng, rows = random.Random(14), []
    for i in range(24):
        text = genome[i % 2 * 2][1][:1500]
        size = 350 + rng.randrange(-40, 40)
        pos = rng.randrange(0, len(text) - size)
        rows += [(i, 0, f"p{i}", text[pos : pos + 100], "I" * 100), (i, 1, f"p{i}", rc(text[pos + size - 100 : pos + size]), "J" * 100)]
    rows[1] = (0, 1, "p0", dna(100, 55), "J" * 100)
    rows[2:4] = [(1, 0, "p1", dna(100, 56), None), (1, 1, "p1", dna(100, 57), None)]
    mates = spark.createDataFrame(rows, "pair_id bigint, mate int, name string, seq string, qual string")
    got = {(r.read_id, r.nth): r.line.split("\t") for r in plans.sam_pairs(mates, index).collect()}
    assert {k for k in got if not k[1]} == {(i, 0) for i in range(48)}
    for i in range(2, 24):
        a, b = got[2 * i, 0], got[2 * i + 1, 0]
        assert a[0] == b[0] == f"p{i}" and int(a[1]) & 0x43 == 0x43 and int(b[1]) & 0x83 == 0x83 and a[6] == b[6] == "="
        assert a[7] == b[3] and b[7] == a[3] and a[2] == b[2] and int(a[8]) == -int(b[8]) and abs(int(a[8])) == max(int(a[3]), int(b[3])) + 100 - min(int(a[3]), int(b[3]))
        assert (int(a[1]) & 0x20 > 0) == (int(b[1]) & 0x10 > 0) and f"MC:Z:{b[5]}" in a and f"MC:Z:{a[5]}" in b
    near, lost = got[0, 0], got[1, 0]
    assert int(near[1]) & 0x9 == 0x9 and not int(near[1]) & 0x2 and int(lost[1]) & 0x5 == 0x5 and lost[2:4] == near[2:4] and lost[5] == "*" and lost[6] == "=" and lost[7] == near[3]
    assert [got[2, 0][k] for k in (2, 3, 5, 6, 7, 8)] == ["*", "0", "*", "*", "0", "0"] and int(got[2, 0][1]) == 0x4D and int(got[3, 0][1]) == 0x8D


def test_insert_stats(spark):
    sizes = [(1, 300 + i % 21) for i in range(200)] + [(2, 5)] * 3 + [(1, 9000)]
    got = {r["dir"]: r for r in pairing.insert_stats(spark.createDataFrame(sizes, "dir int, dist bigint")).collect()}
    a = sorted(x for d, x in sizes if d == 1)
    assert got[2].failed and not got[1].failed
    assert [got[1][p] for p in ("p25", "p50", "p75")] == [a[int(p * len(a) + 0.499)] for p in (0.25, 0.5, 0.75)]


def test_mapq_column_equals_function(spark):
    rows = [(s, sub, csub, n, q, 100, f) for s in (0, 30, 80, 100) for sub in (0, 60) for csub in (0, 90) for n in (0, 3) for q in (40, 104) for f in (0.0, 0.25)]
    df = spark.createDataFrame(rows, "score int, sub int, csub int, sub_n int, qlen int, rlen int, f double")
    o = Options()
    for r in df.withColumn("q", mapping.mapq_column(*[F.col(c) for c in df.columns], o)).collect():
        region = mapping.Region(0, 0, 0, 0, 0, r.rlen, 0, r.qlen, r.score, r.score, 0, 0, r.f, False, "", csub=r.csub, sub=r.sub, sub_n=r.sub_n)
        assert r.q == mapping.mapq(region, o), r


def test_files_round_trip(spark, genome, index, tmp_path):
    fq = tmp_path / "a.fq"
    fq.write_text("".join(f"@r{i}/1 note\n{genome[0][1][i * 40 : i * 40 + 120]}\n+\n{'I' * 120}\n" for i in range(5)))
    reads = readers.read_fastq(spark, str(fq))
    assert [(r.name, r.comment, len(r.seq)) for r in reads.orderBy("ord").collect()] == [(f"r{i}", "note", 120) for i in range(5)]
    bad = tmp_path / "b.fq"
    bad.write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="torn record"):
        readers.read_fastq(spark, str(bad)).collect()
    fa = tmp_path / "g.fa"
    fa.write_text("".join(f">{n} about\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in genome))
    assert [(r.name, r.anno, r.seq) for r in readers.read_fasta(spark, str(fa)).orderBy("rid").collect()] == [(n, "about", s) for n, s in genome]
    named = reads.withColumn("read_id", F.col("ord"))
    body = plans.sam(plans.align(named.select("read_id", "seq"), index), named, index)
    emit.write_sam(emit.header(index.contigs, Options(read_group="@RG\\tID:x")), body, str(tmp_path / "o.sam"))
    back = readers.read_sam(spark, str(tmp_path / "o.sam"))
    assert [(r.qname, r.rname, r.pos, r.nm) for r in back.orderBy("qname").collect()] == [(f"r{i}", "c0", i * 40, 0) for i in range(5)]
    pairs = evaluate.paired(back, back)
    assert evaluate.metrics(evaluate.confusion(pairs, evaluate.STRICT)).first().accuracy == 1.0
    index.save(str(tmp_path / "index"))
    assert plans.Index.load(spark, str(tmp_path / "index")).total == index.total


def test_smart_pairs(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c")], "ord bigint, name string")
    assert [r.mate for r in readers.smart_pairs(df).orderBy("ord").collect()] == [0, 1, None, None, 0, 1]


def test_options():
    assert Options().with_match(2).mismatch == 8 and Options(mismatch=3).with_match(2).mismatch == 3
    assert Options.preset("ont2d").min_seed_len == 14
    with pytest.raises(ValueError):
        Options.preset("none")
