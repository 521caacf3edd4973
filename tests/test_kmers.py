"""K-mers as numbers, against k-mers cut from strings; and the queries that read the reference through them."""

import random
from collections import Counter

import pytest

from seqloom.operators import chaining, hits, kmers, refindex, seeding
from seqloom.plans import align as plans
from seqloom.plans import queries

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def dna(n, seed, letters="ACGT"):
    return "".join(random.Random(seed).choices(letters, k=n))


@pytest.fixture(scope="module")
def contigs():
    shared = dna(200, 7)
    return [dna(70_000, 1, "ACGTN") + shared, None, "", "ACGTACGTACGT", "acgt" * 5, "A" * 500, rc(shared) + dna(40, 2), "AACCGGTTAACCGGTT", "TTTäACGTACGTACGTAC"]


@pytest.fixture(scope="module")
def seqs(spark, contigs):
    return spark.createDataFrame(list(enumerate(contigs)), "rid bigint, seq string")


def cleaned(s):
    return "".join(c if c in "ACGT" else "A" for c in (s or "").upper())


def all_places(contigs, k):
    for rid, s in enumerate(contigs):
        for strand, x in enumerate((cleaned(s), rc(cleaned(s)))):
            for i in range(len(x) - k + 1):
                yield x[i : i + k], rid, strand, i


@pytest.fixture
def tables(spark, contigs, monkeypatch):
    """The queries' tables: contigs, and reads with k-mers of the long contig."""
    long_ = cleaned(contigs[0])
    texts = [long_[100:160], rc(long_[65_500:65_580]), long_[10:40] + "N" + long_[41:60], "ACG", "", dna(60, 99)]
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id bigint, seq string")
    ref = spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(contigs)], "rid bigint, name string, seq string")
    monkeypatch.setattr(queries, "reads", lambda *_: reads)
    monkeypatch.setattr(queries, "seqs", lambda *_: ref)
    return reads, ref


def by_chunks(tables):
    return refindex.kmer_positions(refindex.ref_chunks(tables[1], 14), 14)


def rows(df):
    return sorted(map(str, df.collect()))


def watched(monkeypatch):
    """What queries read of the reference's places."""
    seen, make = [], kmers.places
    monkeypatch.setattr(kmers, "places", lambda *a: (seen.append(make(*a)), seen[-1])[1])
    return seen


def test_places_of_wanted_kmers(spark, contigs, seqs):
    for k in (5, 14, 16, 21):
        reads = spark.createDataFrame([(cleaned(contigs[0])[65_530:65_560],), ("ACGTNACGTACGTACGTACGTACGTACGT",), ("AC",), (None,)], "seq string")
        want = {x[i : i + k] for x in (r.seq or "" for r in reads.collect()) for i in range(len(x) - k + 1)}
        want = {x for x in want if "N" not in x}
        every = [p for p in all_places(contigs, k)]
        found = [tuple(r) for r in kmers.places(kmers.texts(seqs, k), kmers.wanted(reads, k), k).collect()]
        assert set(found) <= set(every) and len(set(found)) == len(found)
        assert {p for p in every if p[0] in want} <= set(found) and (k == 5 or len(found) < len(every) / 50)


def test_coverage_gaps_read_wanted_places_only(spark, tables, monkeypatch):
    seen = watched(monkeypatch)
    got = queries.coverage_gaps(spark, "")
    m = seeding.maximal_matches(tables[0], by_chunks(tables), 14, 19).groupBy("read_id", "qbeg", "len").count()
    assert rows(got) == rows(seeding.gaps(tables[0], m)) and got.count() > 0 and seen[0].count() < 2000


def test_counts(spark, contigs, seqs, monkeypatch):
    monkeypatch.setattr(kmers, "COUNTED", 5000)
    for k in (4, 14, 21):
        got = kmers.counts(seqs, k).collect()
        assert {r.kmer: r.occ for r in got} == Counter(p[0] for p in all_places(contigs, k)) and len(got) == len({r.kmer for r in got})
    assert kmers.counts(seqs.limit(0), 14).count() == 0


def test_kmer_count(spark, tables):
    assert "generate" not in queries.kmer_count(spark, "")._jdf.queryExecution().optimizedPlan().toString().lower().replace("generate explode(p", "").split("flatmapgroups")[0]
    assert rows(queries.kmer_count(spark, "")) == rows(by_chunks(tables).groupBy("kmer").count().withColumnRenamed("count", "occ"))


def test_hit_expansion_reads_wanted_places_once(spark, tables, monkeypatch):
    seen = watched(monkeypatch)
    got = queries.hit_expansion(spark, "")
    m = seeding.maximal_matches(tables[0], by_chunks(tables), 14)
    assert rows(got) == rows(hits.expand(seeding.smems(m), m, queries.O.max_occ)) and got.count() > 0 and seen[0].count() < 2000
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_symmetry_without_a_join(spark, tables):
    bad = spark.createDataFrame([("AACC", 2), ("GGTT", 3), ("ACGT", 4), ("CCCC", 5), ("TTGG", 6), ("CCAA", 6)], "kmer string, occ bigint")
    got = refindex.validate(bad)
    assert got.first().asDict() == {"n_kmers": 6, "n_places": 26, "n_unequal": 3}
    assert refindex.validate(bad.limit(0)).first().asDict() == {"n_kmers": 0, "n_places": None, "n_unequal": 0}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    places = by_chunks(tables)
    assert queries.kmer_symmetry(spark, "").first().asDict() == {"n_kmers": places.select("kmer").distinct().count(), "n_places": places.count(), "n_unequal": 0}


def test_strand_choice_reads_ends_only(spark, tables, monkeypatch):
    seen = watched(monkeypatch)
    got = queries.strand_choice(spark, "")
    index = by_chunks(tables).groupBy("kmer").count().withColumnRenamed("count", "occ")
    assert rows(got) == rows(seeding.choose_strand(tables[0], index, 14)) and got.count() == 4 and seen[0].count() < 100


def test_chains_read_wanted_places_only(spark, tables, monkeypatch):
    seen = watched(monkeypatch)
    monkeypatch.setattr(queries, "_index", None)  # chains need no chunks of text
    got = queries.chains(spark, "")
    index = plans.build_index(tables[1], 14)
    m = seeding.maximal_matches(tables[0], index.positions, 14)
    full = hits.doubled(hits.expand(seeding.smems(m), m, queries.O.max_occ), index.contigs, index.total, tables[0])
    want = chaining.chains_of_reads(full, queries.O).selectExpr("read_id", "chain_no", "rid", "strand", "weight", "kept", "size(seeds) AS n_seeds")
    assert rows(got) == rows(want) and got.count() > 0 and seen[0].count() < 2000
