"""Corpus operators against brute force on small fixtures, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import ann, bytewise, chat, jaccard, langid, media, mixing, packing, sharding, substring_dedup, tokens, toxicity
from seqloom.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string"


def sentence(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base, common = sentence(rng, 120), sentence(rng, 40, 5000)
    out = [(i, sentence(rng, 60 + i), "en", f"s{i % 3}") for i in range(12)]
    for i in range(12, 24):  # near copies of one text
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"x{i}"
        out.append((i, " ".join(words), "en", "s0"))
    out += [(30 + i, f"{sentence(rng, 30)} {common}\n{sentence(rng, 20)}", "en", None) for i in range(4)]
    out += [(40, None, None, "s1"), (41, "", "en", "s1"), (42, " \n\t", "en", "s2"), (43, "One two", "en", "s2"), (44, "one TWO", "en", "s2"), (45, out[3][1], "en", "s2"), (45, out[3][1], "en", "s2")]
    out += [(None, base, "en", "s0"), (46, "é" * 50 + " " + sentence(rng, 9000, 9000), "fr", "s0"), (47, "a\x00b  c d e f " * 20, "en", "s0")]
    return [(i, t, lang, s, None if t is None else len(t), "x") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["ab  c\tde", None, "", "c ab", "Ab", " x", "y"]
    data, at = bytewise.column_bytes(pa.array(texts))
    starts, ends, first = bytewise.words(data, at)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [w for t in texts for w in (t or "").encode().split()]
    assert list(np.diff(first)) == [len((t or "").split()) for t in texts]
    plain, lower = (bytewise.hash_words(data, starts, ends, x) for x in (False, True))
    assert plain[0] == plain[4] and plain[1] == plain[3] and plain[0] != plain[5] and lower[0] == lower[5] and len(set(plain)) == 6


def test_substring_dedup(docs, none, rows):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 12):
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = Counter()
    for i, w in words:
        gone = {k + x for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for x in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = substring_dedup.dedup(docs, keep_text=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(n for i, *_ in want for n in [1]) and any(r.n_removed for r in got) and all(r.label == "x" for r in got)
    for r in got:
        assert all(f.length >= 13 and f.ref_doc < r.doc_id for f in r.factors)
        assert r.n_removed or r.text == next(t for i, t, *_ in rows if i == r.doc_id and (t is None or len((t or "").split()) == r.n_words))
    assert substring_dedup.dedup(none).count() == 0


def test_substring_dedup_tells_apart_windows_whose_hashes_share_32_bits(spark):
    words = [f"w{i}" for i in range(4000)]
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    starts, ends, _ = bytewise.words(data, np.array([0, len(data)]))
    hashes = bytewise.hash_words(data, starts, ends, lower=False)
    least = int(np.argmin(bytewise.hash_runs(hashes, 5)))  # an anchor that few others undercut
    rng = np.random.default_rng(8)
    picked = rng.integers(0, len(words), (400_000, 13))
    picked[:, 4:9] = np.arange(least, least + 5)
    with np.errstate(over="ignore"):
        checks = np.zeros(len(picked), dtype=np.uint64)
        for i in range(13):
            checks = checks * np.uint64(bytewise._BASE) + hashes[picked[:, i]]
    checks = bytewise.mix(checks) >> np.uint64(32)
    order = np.argsort(checks, kind="stable")
    twins = np.flatnonzero(checks[order][1:] == checks[order][:-1])
    pairs = [(picked[order[i]], picked[order[i + 1]]) for i in twins]
    assert len(pairs) > 5 and all((a != b).any() for a, b in pairs)
    texts = [" ".join(words[i] for i in row) for pair in pairs for row in pair]
    got = substring_dedup.dedup(spark.createDataFrame([*enumerate(texts), (9000, texts[0])], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {**dict.fromkeys(range(len(texts)), 0), 9000: 13}


def brute_components(sets, percent=80):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_join(spark, docs, none, rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    want = brute_components(sets)
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r
    assert jaccard.join(none).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_jaccard_index_loses_no_pair(percent):
    """Any two sets that are similar share an entry, at the edge of the bound too."""
    rng = np.random.default_rng(percent)
    for n in (1, 2, 5, 9, 40, 130, 600):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets = [base]
        for _ in range(12):
            out = rng.permutation(base)[: n - int(rng.integers(0, max(1, int(n * (100 - percent) / 100)) + 1))]
            new = rng.integers(0, 2**64, int(rng.integers(0, max(1, int(n * (100 - percent) / 100)) + 1)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([out, new])))
        sets = [np.unique(s) for s in sets if len(s)]
        made = jaccard.Sets(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
        key, row = jaccard.entries(made, {}, percent)
        mine = defaultdict(set)
        for k, r in zip(key.tolist(), row.tolist()):
            mine[r].add(k)
        sketches, nodes = made.sketches(), made.nodes()
        for i in range(len(sets)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    assert mine[i] & mine[j]
                    one = lambda k: np.array([len(sets[k])])
                    assert jaccard.sketches_allow(one(i), one(j), sketches.slice(i, 1), sketches.slice(j, 1), percent).all()
                    a, b, _ = jaccard.candidates(made.sizes, np.arange(len(sets)), sketches, np.array([i, j]), None, percent)
                    assert sorted([*a, *b]) == [j, i]
                    a, b, _ = jaccard.candidates(made.sizes, np.arange(len(sets)), sketches, np.array([i]), np.array([j]), percent)
                    assert sorted([*a, *b]) == [j, i]
                assert jaccard.similar(made.take(np.array([i])), made.take(np.array([j])), percent)[0] == (100 * common >= percent * (len(sets[i]) + len(sets[j]) - common))
                assert (nodes[i] == nodes[j]) == (len(sets[i]) == len(sets[j]) == common)


def test_jaccard_order_by_cost_puts_hot_segments_last():
    band, n = 7, jaccard.segments(7, 80)
    found = {s: (4000.0**2 / 16, 4000.0) for s in range(n)}
    found[3] = (4000.0**2 / 4, 4000.0)
    rank = jaccard.ranks({band: found}, 80)[band]
    assert rank[3] > rank[4] and rank[3] > rank[n + 4] and rank[n + 3] > rank[3]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_jaccard_gives_few_pairs_of_a_large_group(spark, monkeypatch):
    """Near copies without a common middle: what is compared grows with the group, not with its square."""
    monkeypatch.setattr(jaccard, "SIDE", 100)  # several blocks
    made = []
    verify = jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *a: (made.append(pairs.count()), verify(pairs, *a))[1])
    rng = random.Random(3)
    base = sentence(rng, 150, 10**6).split()
    texts = {}
    for i in range(600):
        words = list(base)
        for k in range(1 + i % 6):
            words[rng.randrange(150)] = f"y{i}x{k}"
        texts[i] = " ".join(words)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute_components({i: shingles(t) for i, t in texts.items()})
    assert sum(made) < 40 * 600  # of 180,000 pairs


def test_jaccard_lists_of_much_the_same_nodes_are_one(spark):
    """Near copies share many lists: they are closed once for the group, not once for each of its lists."""
    rows = [(k, n) for k in range(40) for n in range(60) if (n * 7 + k) % 5]  # 40 lists of 48 out of 60 nodes
    rows += [(100 + k, n) for k in range(3) for n in (200, 300 + 9 * k, *range(310 + 100 * k, 330 + 100 * k))]  # one node in common
    got = defaultdict(set)
    for r in jaccard.merged(spark.createDataFrame(rows, "list_id bigint, node bigint")).collect():
        got[r.list_id].add(r.node)
    old = defaultdict(set)
    for k, n in rows:
        old[k].add(n)
    assert all(any(x <= y for y in got.values()) for x in old.values())  # no pair is lost
    assert sorted(map(len, got.values())) == [22, 22, 22, 60] and {100, 101, 102} <= set(got)
    assert jaccard.merged(spark.createDataFrame([], "list_id bigint, node bigint")).count() == 0


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    got = packing.pack_documents(docs, capacity=512, keep_ids=True).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 512):
            part = np.array(ids[k : k + 512], dtype="<u4").tobytes()
            want[i, k // 512, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 512
    assert len(places) <= 1.05 * sum(r.length for r in got) / 512  # more than half of a sequence is no rare length here
    assert packing.pack_documents(none).count() == 0


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, known = Tokenizer.from_file(tokens.default_path()), tokens.words(tokens.default_path())
    for text in ("It's 12,5% of Ärger!! naïve été", "<|endoftext|> don't x<|endoftext|>y", " a b ΣΑΣ 日本語 مرحبا ﬁ ½ ª", "a'll b've 'S", "--..--&&&  ###x9y"):
        assert np.frombuffer(known.encode(text.encode()), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_fullest_combination_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 90)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        got = packing.fullest(counts, room)
        assert all(n <= counts[x] for x, n in got.items()) and sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)
    hist = {rng.randrange(1, 100): rng.randrange(1, 50) for _ in range(60)}
    used = Counter()
    for chosen, times in packing.plan(hist, 100):
        assert sum(x * n for x, n in chosen.items()) <= 100
        for x, n in chosen.items():
            used[x] += n * times
    assert used == Counter(hist)


def png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media_sniffing(spark):
    import gzip

    wav, gz = media.to_wav(b"abcd"), gzip.compress(b"hello" * 100)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    rows = [(png(), "image/jpeg"), (b"junk" + wav + b"--" + gz + b"tail", "text/plain"), (gif, "image/gif"), (png()[:-3], "image/png"), (b"BM I am a text, RIFF too", "text/plain"), (b"", None), (None, "x")]
    got = media.sniff_column(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, content binary, declared string")).orderBy("i").collect()
    assert [r.media_type for r in got] == ["image/png", "text/plain", "image/gif", "image/png", "text/plain", None, "x"]
    assert [r.corrected for r in got] == [True, False, False, False, False, False, False]
    assert [(m.offset, m.type, bytes(m.content)) for m in got[1].media] == [(4, "audio/wav", wav), (6 + len(wav), "application/gzip", gz)]
    assert not got[3].media and not got[4].media


def test_false_starts_are_read_once(spark):
    import time

    find = media.automaton()
    took = []
    for n in (20_000, 200_000):
        value = b"%PDF-PK\x03\x04" * n
        began = time.perf_counter()
        assert media.sniff(value, find) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * max(took[0], 0.02)
    pdf = b"%PDF-1.4 startxref 9 %%EOF"
    assert media.sniff(b"%PDF-x " + pdf + b"..", find) == [(0, 7 + len(pdf), "application/pdf")] and media.sniff(b"%PDF- %%EOF startxref", find) == []


def test_media_features_by_brute_force(spark):
    texts = ["", "abc", "é" * 40, "GIF89a no picture"]
    got = {r.doc_id: r for r in media.store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        x = list(raw + bytes(-len(raw) % 64 if raw else 64))
        want = f"type=audio/wav;rate=8000;samples={len(x)};sum={sum(x)};power={sum((b - 128) ** 2 for b in x)};crossings={sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:]))};values={len(set(x))};embedded=none"
        assert got[i].feature == want


def test_media_round_trip(docs, none, rows):
    got = media.store_texts(docs, keep=True).collect()
    want = Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes for r in got)
    assert media.store_texts(none).count() == 0


def test_sharding(docs, none, rows, monkeypatch):
    for cell, bundles in ((20_000, 512), (12, 3)):
        monkeypatch.setattr(sharding, "CELL", cell)
        monkeypatch.setattr(sharding, "BUNDLES", bundles)
        got = sharding.shard(docs, 4).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        for s in range(4):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(none).count() == 0


def test_shards_are_even_and_keep_groups_together(spark, monkeypatch):
    """Equal bytes on both sides of CELL; equal texts stay together unless they are over a quarter of a shard."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.randrange(5, 90))) for i in range(1200)]
    rows += [(2000 + i, "a copy of a text") for i in range(30)] + [(3000 + i, rows[5][1] * 3) for i in range(150)] + [(4000 + i, None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for cell, bundles in ((20_000, 512), (100, 40)):
        monkeypatch.setattr(sharding, "CELL", cell)
        monkeypatch.setattr(sharding, "BUNDLES", bundles)
        got = sharding.shard(docs, 8).collect()
        loads = [sum(r.size for r in got if r.shard == s) for s in range(8)]
        assert max(loads) <= 1.05 * sum(loads) / 8
        assert len({r.shard for r in got if 2000 <= r.doc_id < 2030}) == 1


def test_vectors_fill_bins_evenly():
    v = np.random.default_rng(0).exponential(size=(3000, 3)) + 0.1
    bins = sharding.place(v, 16)
    loads = np.stack([v[bins == b].sum(axis=0) for b in range(16)])
    assert (loads.max(axis=0) / loads.mean(axis=0) < 1.02).all()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (None, x[0].tolist()), (3000, [1.0, 2.0]), (50, x[50].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=5).collect()
    near = defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        near[r.query_id].append(r)
    assert set(near) == {i for i in range(0, 1500, 50)}
    wide = x.astype(np.float64)
    norms = np.linalg.norm(wide, axis=1)
    hit = 0
    for q, rs in near.items():
        cos = wide @ wide[q] / (norms * norms[q])
        cos[q] = -2
        want = np.lexsort((np.arange(1500), -np.round(cos, 12)))[:5]
        hit += len({*want.tolist()} & {r.vec_id for r in rs})
        assert [r.rank for r in rs] == [1, 2, 3, 4, 5] and all(abs(r.score - cos[r.vec_id]) < 1e-12 for r in rs)
    assert hit >= 0.9 * 5 * len(near)
    assert [r.vec_id for r in near[100]] == [101, 102, 103, 104, 105]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(few.limit(0)).count() == 0
    far = [(0, [1e200, 1e-9]), (1, [1.0, 1e-12]), (2, [1.0, 1e-5]), (3, [1e300, -1e300])]
    got = ann.nearest(spark.createDataFrame(far, "vec_id bigint, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 3)] and abs(got[2].score - 0.5**0.5) < 1e-15


def test_only_repeated_anchors_are_unpacked():
    rng = np.random.default_rng(4)
    pool, blobs, rows = rng.integers(0, 2**63, 5000).astype(np.uint64), [], []
    for _ in range(6):
        keys, count = rng.choice(pool, 900), rng.integers(1, 6, 900)
        own, ids = np.sort(rng.integers(0, 30, 900)), np.sort(rng.integers(0, 10**9, 30))
        begin, distance, checks, tags = rng.integers(0, 10**6, 900), rng.integers(0, 9, 900), rng.integers(0, 2**63, count.sum()), rng.integers(0, 2**32, 30)
        blobs.append(substring_dedup.packed(keys, own, begin, count, distance, checks, ids, tags))
        ends = np.cumsum(count)
        rows += [(k, b, c, d, tuple(checks[e - c : e].tolist()), ids[o], tags[o]) for k, b, c, d, e, o in zip(keys.tolist(), begin.tolist(), count.tolist(), distance.tolist(), ends.tolist(), own.tolist(), strict=True)]
    often = Counter(r[0] for r in rows)
    want = [r for r in rows if often[r[0]] > 1]
    keys, begin, count, distance, checks, ids, tags = substring_dedup.repeated(blobs)
    ends = np.cumsum(count)
    assert [(k, b, c, d, tuple(checks[e - c : e].tolist()), i, t) for k, b, c, d, e, i, t in zip(keys.tolist(), begin.tolist(), count.tolist(), distance.tolist(), ends.tolist(), ids, tags, strict=True)] == want
    assert 0 < len(want) < len(rows)
    assert all(len(x) == 0 for x in substring_dedup.repeated([substring_dedup.packed(*[np.arange(2)] * 3, np.ones(2), *[np.arange(2)] * 4)]))


def test_lists_of_two_end_with_their_leader(spark, monkeypatch):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (3, 10), (3, 11), (3, 13)], "list_id bigint, node bigint")
    labels = spark.createDataFrame([(10, 0), (11, 1), (12, 0), (13, 3)], "node bigint, component bigint")
    assert {r.list_id for r in jaccard.still_open(members, labels).collect()} == {3}
    # Chains of near copies, and texts that share half of their words: as brute force links them, with and without leaders.
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 10**6, 60).tolist() for _ in range(12)]
    texts = []
    for i, b in enumerate(base):
        for step in range(4):
            b = [*b[:-1], int(rng.integers(0, 10**6))] if step < 3 else b[:30] + base[i - 1][30:]
            texts.append(" ".join(map(str, b)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    want[i] = want[j] = min(want[i], want[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == dict(enumerate(want)) and len(set(want)) < len(want)


def test_queries_visit_near_shards_only(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = (np.repeat(rng.normal(size=(40, 16)), 60, axis=0) + 0.2 * rng.normal(size=(2400, 16))).astype(np.float32)
    monkeypatch.setattr(ann, "SHARD", 64)
    sent, pack = [], ann.route
    monkeypatch.setattr(ann, "route", lambda *a: (sent.append(pack(*a)), sent[0])[1])
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")).collect()
    visited, unit = sent[0].select("shard").distinct().count(), ann.unit(x).astype(np.float64)
    assert visited >= 20 and sent[0].count() < 0.5 * 48 * visited
    hit = 0
    for q in range(0, 2400, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        hit += len({r.vec_id for r in got if r.query_id == q} & {*np.argsort(-cos)[:5].tolist()})
    assert hit >= 0.9 * 5 * 48


def test_mixing(spark, docs, none, rows):
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len((t or "").encode().split())
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, total, free = {}, 1.5 * sum(sizes.values()), set(names)
    while True:  # clamp, give the rest away, again
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    got = mixing.mix(docs).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    copies = mixing.repeat(docs).collect()
    want = Counter()
    for r in mixing.mix(docs, partial=False).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in copies) == +want
    text = "one two three four five six seven eight nine ten"
    same = spark.createDataFrame([(1, text, "s", k) for k in (0, 0, 0)] + [(None, text, None, 1)] * 2, "doc_id bigint, text string, source string, __nth int")
    for share, source_copies in ((1.5, 4), (0.4, 1)):
        got = mixing.repeat(same.where("source = 's'"), share=share).collect()
        assert len(got) == source_copies and got[0].asDict() == {"doc_id": 1, "text": text, "source": "s", "__nth": 0}
    assert len(mixing.repeat(same, share=2.0).collect()) == 10
    assert mixing.mix(none).count() == 0


def test_language_id(spark, none):
    rng = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ei", "ö"], "cc": ["eau", "è", "que", "ti"]}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(rng.choices(list(parts), k=300))]
    df = spark.createDataFrame([*rows, (900, None, None), (901, "12 ++", "aa"), (902, "", "bb"), (903, text("cc", 9000), None)], "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in langid.predict(df, langid.train(df.where("doc_id % 2 = 0"))).collect()}
    assert sum(found[i].lang_pred == lang for i, _, lang in rows if i % 2) >= 0.95 * sum(i % 2 for i, *_ in rows)
    assert [found[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "cc"] and all(0 <= r.score <= 1 for r in found.values())
    assert langid.predict(none, {}).count() == 0 and langid.predict(df.limit(3), {}).first().lang_pred == "und"


def test_bundles_are_sums_of_bound_letters():
    e = langid.Encoder(3, 64)
    vectors, lettered = e.bundle(["abca", "", "b1b", "7"])
    assert lettered.tolist() == [True, False, True, False]
    letter = lambda c: e.letters[e.symbols[ord(c)]].astype(int) if c != " " else e.letters[1].astype(int)
    gram = lambda g: np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2])
    assert (vectors[0] == sum(map(gram, ["abc", "bca", "ca "]))).all() and (vectors[2] == sum(map(gram, ["b b", " b "]))).all()


def test_new_ngrams_leave_remembered_vectors_in_place(monkeypatch):
    e = langid.Encoder(3, 64)
    e.bundle(["abca"])
    places, kept = dict(e.known), e.vectors
    e.bundle(["xyz abd"])
    assert e.vectors is kept and len(e.known) > len(places) and places.items() <= e.known.items()
    texts = ["".join(chr(97 + (i * i + k) % 23) for i in range(k)) for k in range(3, 90)]
    want = np.concatenate([langid.Encoder(3, 64).bundle([t])[0] for t in texts])
    groups = np.arange(len(texts)) % 4
    for limit, bits in ((100_000, 1), (40, 21), (1, 2)):  # n-grams that share slots; a memory that is emptied again and again
        monkeypatch.setattr(langid, "REMEMBERED", limit)
        monkeypatch.setattr(langid, "SLOT_BITS", bits)
        e = langid.Encoder(3, 64)
        assert (np.concatenate([e.bundle([t])[0] for t in texts]) == want).all() and (e.bundle(texts)[0] == want).all()
        assert (e.bundle(texts, groups)[0] == [want[groups == g].sum(axis=0) for g in range(4)]).all()


def test_index_entries_and_sketches_are_small():
    """Five bytes an entry, and eight a node in each part that has one of its entries; two to four bits of sketch a shingle."""
    r = np.random.default_rng(3)
    nodes = r.integers(-(2**63), 2**63 - 1, 300)
    keys, row = r.integers(0, 2**64 - 1, 40_000, dtype=np.uint64), r.integers(0, 300, 40_000)
    keys[:500] = keys[500:1000]  # entries of several nodes
    sent = list(jaccard.dealt_entries(keys, row, nodes, 7))
    part = [int(k >> np.uint64(32)) * 7 >> 32 for k in keys]
    assert sum(len(value) for _, value in sent) <= 5 * len(keys) + 8 * len({*zip(part, row.tolist(), strict=True)}) + 16 * len(sent)
    got = sorted((p, k, n) for p, value in sent for k, n in zip(*(x.tolist() for x in jaccard.met_entries([value])), strict=True))
    assert got == sorted(zip(part, (keys & np.uint64(2**39 - 1)).tolist(), nodes[row].tolist(), strict=True))
    both = jaccard.met_entries([sent[0][1], sent[1][1]])
    assert all((np.concatenate(z) == x).all() for x, z in zip(both, zip(jaccard.met_entries([sent[0][1]]), jaccard.met_entries([sent[1][1]]), strict=True), strict=True))
    assert list(jaccard.dealt_entries(keys[:0], row[:0], nodes[:0], 7)) == []
    sizes = np.array([0, 1, 3, 8, 15, 16, 31, 32, 500, 70_000])
    made = jaccard.Sets(np.concatenate([np.sort(r.integers(0, 2**64 - 1, n, dtype=np.uint64)) for n in sizes]), np.concatenate([[0], np.cumsum(sizes)]))
    widths = np.array([len(x.as_py()) for x in made.sketches()])
    assert widths[:4].tolist() == [0, 1, 2, 8] and (8 * widths[5:] <= 4 * sizes[5:]).all() and (8 * widths[5:] >= 2 * sizes[5:]).all()


def test_operators_without_memory_drop_what_others_remember():
    from seqloom.llm import common

    common.memory("tokens", "x", lambda: [1])
    common.forget("jaccard")
    assert common._memory == {"for": ("jaccard", None), "value": None}
    assert common.memory("tokens", "x", lambda: [2]) == [2]


def test_toxicity(spark, none):
    rng = random.Random(6)
    bad = ["stupidhead", "nastyface", "horridness"]
    rows, labels = [], []
    for i in range(900):
        words = sentence(rng, 80, 400).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    odd = sentence(rng, 80, 400).split()
    for k in range(0, 80, 15):
        odd[k] = "stupidheadz"
    rows += [(9900, None), (9901, ""), (9902, " ".join(odd)), (9903, " ".join(sentence(rng, 80, 400).split()))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, toxic int")
    lift, base = toxicity.trained(spark, docs, table)
    got = {r.doc_id: r.score for r in toxicity.score(docs, lift, base).collect()}
    unseen = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 4 == 0) for i in unseen) >= 0.9 * len(unseen)
    assert got[9902] > got[9903] and got[9900] == got[9901] and all(0 <= s <= 1 for s in got.values())
    lift, base = toxicity.trained(spark, docs, table.limit(0))
    assert toxicity.score(docs, lift, base).first().score < 1e-6
    assert toxicity.score(none, lift, base).count() == 0


def test_toxicity_bags_hold_no_index_of_all_ngrams():
    """Cutting a sample into words holds less than four times what its buckets take."""
    import tracemalloc

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 14))) for _ in range(400)) for _ in range(500)]
    tracemalloc.start()
    try:
        bags = toxicity.Bags(texts)
        assert tracemalloc.get_traced_memory()[1] < 4 * bags.buckets.nbytes
    finally:
        tracemalloc.stop()


def test_toxic_words_of_any_script_and_case(monkeypatch):
    """Character n-grams of every length, of letters in Unicode's lower case; a mark within a word is part of it."""
    assert toxicity.GRAMS == (4, 5, 6) and toxicity.SAMPLE == {1: 2500, 0: 4500}
    texts = ["ÉLÈVE Straßenköter СЛОВО", "Plain sh*t ДУРАК! a", "plain\u00a0x PLAIN", "", None, "x" * 30 + " ÉLÈVE"]
    words = [re.split("[ \t\n\v\f\r]+", t.lower()) if t else [] for t in texts]
    lift = np.random.default_rng(0).random(toxicity.BUCKETS, dtype=np.float32)
    one = {}
    for w in {w for row in words for w in row}:
        part, word, keys, owner, bucket = toxicity.words_of([w])
        mark = f"<{w}>"
        assert len(keys) == 1 and len(bucket) == 1 + sum(max(0, len(mark) - n + 1) for n in (4, 5, 6))
        # Equal n-grams have equal buckets, wherever they stand; others nearly always have others.
        grams = [mark[i : i + n] for n in (4, 5, 6) for i in range(len(mark) - n + 1)]
        assert len(dict.fromkeys(zip(grams, bucket[1:].tolist()))) == len(set(grams))
        one[w] = lift[bucket].mean()
    want = [0.5 + sum(one[w] for w in row) / (len(row) + toxicity.PADDING) for row in words]
    for step in (1 << 19, 7):
        monkeypatch.setattr(toxicity, "STEP", step)
        assert np.allclose(toxicity.logits(texts, lift, 0.5), want)
        bags = toxicity.Bags(texts)
        for (ids, shares), row in zip(bags.rows, words):
            got = sum(s * lift[bags.buckets[bags.begin[i] : bags.begin[i + 1]]].mean() for i, s in zip(ids, shares))
            assert abs(got - sum(one[w] for w in row) / (len(row) + toxicity.PADDING)) < 1e-5
    first, second = (toxicity.words_of([w])[4][1:].tolist() for w in ("abcde", "xbcde"))
    assert len(set(first) & set(second)) == len(["bcde", "cde>", "bcde>"])


def test_chat_parsing():
    text = "On Monday Ann wrote:\n> > first thing said\n> no, I don't think so\nI agree\nwith you"
    own, mine, quotes, n = chat.parse(text)
    assert own == "I agree\nwith you" and n == 2 and {level for level, *_ in quotes} == {1, 2} and len(mine) >= 1
    assert chat.parse("plain")[0] == "plain" and chat.parse("> only quotes here")[0] == ""


def test_chats(spark):
    a, b = "the first thing that I say\nand more", "another thing said here"
    rows = [
        (0, 0, "user", a), (0, 1, "assistant", b), (0, 2, "user", "> another thing\n> said here\nreply to the second one"), (0, 3, "assistant", "> The first   thing that I say\nreply to the first one"),
        (1, 0, "user", f"> {b}\nfrom elsewhere I answer"), (1, 1, "assistant", "> > the first thing that I say\n> from elsewhere I answer\nyes it is so"),
        (2, None, "user", "lost words in here"), (None, 0, "user", "> lost words in here\nx"), (2, 0, "user", None), (2, 0, "user", None), (3, 0, "user", "> nothing like this was said\nown"),
    ]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn): r for r in got}
    assert (at[0, 2].reply_conv, at[0, 2].reply_turn, at[0, 2].depth) == (0, 1, 1) and (at[0, 3].reply_turn, at[0, 3].text) == (0, "reply to the first one")
    assert (at[1, 0].conversation_id, at[1, 0].depth) == (0, 1) and (at[1, 1].reply_conv, at[1, 1].conversation_id, at[1, 1].depth) == (1, 0, 2)
    assert [k for k, _ in sorted(((k, r.place) for k, r in at.items() if r.conversation_id == 0), key=lambda x: x[1])] == [(0, 0), (0, 3), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert at[3, 0].reply_conv is None and at[3, 0].text == "own" and at[2, None].reply_conv is None and at[None, 0].reply_conv is None
    for c in {r.conversation_id for r in got}:
        assert sorted(r.place for r in got if r.conversation_id == c) == list(range(sum(r.conversation_id == c for r in got)))
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_replies_to_one_message_stand_in_order(spark, monkeypatch):
    """Many replies to one message, in many cells; conversations whose turns fill several blocks; rows without a turn."""
    monkeypatch.setattr(chat, "BLOCK", 4)
    line = "a line that very many people quote"
    rows = [(0, t, "user", line if t == 2 else f"some turn {t} here") for t in range(11)] + [(c, t, "user", f"> {line}\nreply {c} {t}") for c in range(1, 30) for t in (5, 1)] + [(0, None, "user", f"lost {i % 3}") for i in range(7)]
    random.Random(2).shuffle(rows)
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    zero = sorted((r for r in got if r.conversation_id == 0), key=lambda r: r.place)
    assert [r.place for r in zero] == list(range(len(rows)))
    want = [(0, 0), (0, 1), (0, 2), *((c, t) for c in range(1, 30) for t in (1, 5)), *((0, t) for t in range(3, 11)), *[(0, None)] * 7]
    assert [(r.conv_id, r.turn) for r in zero] == want


def test_levels_of_lines_by_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        text = "\n".join(rng.choice(["> a", ">> b", "", "  ", "Ann wrote:", "> Bob writes:", "own words"]) for _ in range(rng.randrange(12)))
        plain = [(m.group().count(">"), x[m.end() :]) if (m := chat._MARKS.match(x)) else (0, x) for x in text.split("\n")]
        want = [(-1, x) if chat._SAID.search(x) and next((b for b, rest in plain[i + 1 :] if b or rest.strip()), 0) > a else (a, x) for i, (a, x) in enumerate(plain)]
        assert chat.levels(text) == want
    assert len(chat.levels("Ann wrote:\n" * 200_000)) == 200_001


def test_chats_link_short_quotes_within_a_conversation(spark):
    rows = [(0, 0, "user", "Yes"), (1, 0, "user", "shall we begin with it"), (1, 1, "assistant", "Sounds good"), (1, 2, "user", "> sounds  GOOD\nthen let us"), (1, 3, "assistant", "> Yes\nno such thing here"), (1, 4, "user", "> Later\nquoted too soon"), (1, 5, "user", "Later")]
    at = {(r.conv_id, r.turn): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert (at[1, 2].reply_conv, at[1, 2].reply_turn, at[1, 2].depth, at[1, 2].text) == (1, 1, 1, "then let us")
    assert at[1, 3].reply_conv is None and at[1, 4].reply_conv is None and at[1, 3].conversation_id == 1


def test_language_of_few_rows_among_many_is_learned(spark, tmp_path):
    """No training row is left out, however many other rows there are."""
    n = 60_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("kalo mitu lomi").alias("text"), F.lit("aa").alias("lang"))
    rare = spark.createDataFrame([(n + i, "schung eisch ungei", "bb") for i in range(3)], "doc_id bigint, text string, lang string")
    assert any(zlib.crc32(str(n + i).encode()) % 5 for i in range(3))
    for only in range(3):  # each of them is enough
        if zlib.crc32(str(n + only).encode()) % 5:
            docs.unionByName(rare.where(F.col("doc_id") == n + only)).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
            got = langid.query(spark, str(tmp_path)).where(F.col("doc_id") == n + only).first()
            assert got.lang_pred == "bb"
