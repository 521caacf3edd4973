"""Substring dedup by relative Lempel-Ziv parsing of each document against an index of all earlier ones.

The reference of a document is every document with a smaller id. Its index is kept in blocks, by hash:
from every window of ``window`` words the run of five words with the smallest hash is taken (a minimizer),
so equal windows have equal anchors and only about a fifth of all positions is indexed. A block holds the
anchors of its hash range from all documents, each with a check number for each window that it stands for.
A block thus knows, for each window, the earliest document that has it, and where.

With these hits a document is parsed from left to right, as relative Lempel-Ziv does it: at the pointer the factor is
the longest stretch that goes on along one passage of one reference, the pointer moves to its end, and a word
at which no window of a reference begins is a literal. Factors have a window at least. At each factor's
end the windows that begin in it and end behind it are checked, too: one that some other reference has
belongs to the duplicate span, so a passage that is put together from two references is found to its last word.

Within a task, a window that an earlier document of the same task has is settled there and sent on only
once, so a passage in a third of all documents reaches its block a few times for each task. The text
itself is shuffled once, to meet its spans.

Two windows are held equal if a 64-bit hash of the anchor, the place of the anchor and a 64-bit hash of the
whole window agree.

Defined results: null or empty text has no words; documents shorter than a window keep all; rows with a
null id are kept whole and are no reference; rows of equal id never take from each other, and rows that repeat lose the
same; texts are parsed whole however long they are; other columns take no part; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import bound_batches, cut, forget, partitions, table

WINDOW, ANCHOR = 13, 5
#: Bytes of text that a task works on at once.
CHUNK = 2_000_000
_KINDS = ["<u8", "<u4", "<u4", "u1", "u1", "<u8", "<i8", "<u4"]
#: Of these, what compresses: places and ids, as steps from one to the next.
_STEPS = (1, 2, 3, 4, 6)


def packed(*arrays: np.ndarray) -> bytes:
    """``B.blob`` of arrays of ``_KINDS``, without loss, with small numbers compressed a byte place at a time."""
    out = []
    for i, (x, kind) in enumerate(zip(arrays, _KINDS, strict=True)):
        x = np.ascontiguousarray(x.astype(kind))
        if i in _STEPS:
            with np.errstate(over="ignore"):
                x = np.concatenate([x[:1], x[1:] - x[:-1]]) if x.itemsize > 1 else x
            x = np.frombuffer(pa.compress(x.view("u1").reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True), dtype="u1")
        out.append(x)
    return B.blob(*out)


def unpacked(value: bytes) -> list[np.ndarray]:
    out = B.unblob(value, ["u1" if i in _STEPS else kind for i, kind in enumerate(_KINDS)])
    for i in _STEPS:
        kind, n = np.dtype(_KINDS[i]), len(out[7] if i == 6 else out[0])
        x = np.frombuffer(pa.decompress(out[i].tobytes(), decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), dtype="u1")
        x = np.ascontiguousarray(x.reshape(kind.itemsize, n).T).view(kind).ravel()
        out[i] = np.cumsum(x, dtype=kind) if kind.itemsize > 1 else x
    return out


def repeated(values: list) -> list[np.ndarray]:
    """Of packed anchors those whose hash stands more than once: keys, begin, count, distance, checks, ids, tags.

    Others settle nothing. Hashes are looked at first, so a group is never unpacked as a whole.
    """
    keys = np.concatenate([np.frombuffer(v, dtype="<u8", count=int(np.frombuffer(v, dtype="<i8", count=1)[0]), offset=8 * len(_KINDS)) for v in values])
    keys.sort()
    keys = np.unique(keys[1:][keys[1:] == keys[:-1]])
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    for v in values:
        own, row, begin, count, distance, checks, ids, tags = unpacked(v)
        ok = keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own if len(keys) else np.zeros(len(own), dtype=bool)
        kept = (own[ok], begin[ok].astype(np.int64), count[ok].astype(np.int64), distance[ok].astype(np.int64), checks[np.repeat(ok, count)], ids[row[ok]], tags[row[ok]])
        for held, x in zip(out, kept, strict=True):
            held.append(x)
    return [np.concatenate(x) for x in out]


def anchors(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of words in rows that begin at ``first``: for each anchor its hash, row, first window (as a place among all
    words), number of windows, and distance from the first window; and a check number for each window."""
    n = len(hashes) - window + 1
    empty = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return empty.astype(np.uint64), empty, empty, empty, empty, empty.astype(np.uint64)
    runs = B.hash_runs(hashes, ANCHOR)
    best, at = runs[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, window - ANCHOR + 1):
        less = runs[j : j + n] < best
        best[less] = runs[j : j + n][less]
        at[less] = j
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = np.flatnonzero(rows[:n] == rows[window - 1 :])
    where = valid + at[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (valid[1:] != valid[:-1] + 1) | (rows[valid[1:]] != rows[valid[:-1]])
    begin = np.flatnonzero(new)
    windows = valid[begin]
    return best[windows], rows[windows], windows, np.diff(begin, append=len(valid)), at[windows], B.hash_runs(hashes, window)[valid]


def settle(keys: np.ndarray, docs: np.ndarray, begin: np.ndarray, count: np.ndarray, distance: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows that a smaller document has too: (anchor, window's place, that document, the place there)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    several = np.zeros(len(keys), dtype=bool)
    several[1:] = same
    several[:-1] |= same
    picked = order[several]
    sizes = count[picked]
    which = np.repeat(picked, sizes)
    step = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    firsts = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        full = B.mix(keys[which] + B.mix(checks[firsts[which] + step] + B.mix((distance[which] - step).astype(np.uint64))))
    doc, place = docs[which], begin[which] + step
    order = np.lexsort((place, doc, full))
    full = full[order]
    head = np.ones(len(full), dtype=bool)
    head[1:] = full[1:] != full[:-1]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = doc[order] > doc[order][lead]
    mine, ref = order[later], order[lead[later]]
    return which[mine], place[mine], doc[ref], place[ref]


def spans(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, ref: np.ndarray, ref_place: np.ndarray) -> pa.RecordBatch | None:
    """Runs of windows along one passage of one reference, as a row for each document."""
    if not len(doc):
        return None
    order = np.lexsort((place, tag, doc))
    doc, tag, place, ref, ref_place = (x[order] for x in (doc, tag, place, ref, ref_place))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] != place[:-1] + 1) | (ref[1:] != ref[:-1]) | (ref_place[1:] != ref_place[:-1] + 1)
    begin = np.flatnonzero(new)
    rows = np.stack([place[begin], np.diff(begin, append=len(doc)), ref[begin], ref_place[begin]], axis=1).astype("<i8")
    doc, tag = doc[begin], tag[begin]
    head = np.ones(len(doc), dtype=bool)
    head[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    bounds = np.append(np.flatnonzero(head), len(doc))
    return pa.RecordBatch.from_arrays([pa.array(doc[head].astype(np.int64)), pa.array(tag[head].astype(np.int64)), B.split_rows(rows, bounds)], names=["doc_id", "tag", "value"])


def duplicate_spans(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, tag, value): packed runs of windows that a smaller document has."""
    parts = 4 * partitions(docs.sparkSession)  # small groups: a task holds one at a time, in the JVM and in Python

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("substring_dedup")
        for batch in B.chunks(batches, 1, CHUNK):
            batch = batch.filter(batch.column(0).is_valid())
            data, rows = B.column_bytes(batch.column(1))
            starts, ends, first = B.words(data, rows)
            keys, row, begin, count, distance, checks = anchors(B.hash_words(data, starts, ends, lower=False), first, window)
            if not len(keys):
                continue
            begin = begin - first[row]
            ids, tags = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.uint32)
            which, place, ref, ref_place = settle(keys, ids[row], begin, count, distance, checks)
            found = spans(ids[row[which]], tags[row[which]], place, ref, ref_place)
            if found:
                to = pa.array((found.column(0).to_numpy() % parts).astype(np.int32))
                yield pa.RecordBatch.from_arrays([to, *found.columns], names=["part", "doc_id", "tag", "value"])
            open_ = np.bincount(which, minlength=len(keys)) < count  # with a window that isn't settled
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            order = order[open_[order]]
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            firsts = np.cumsum(count) - count
            out_parts, out = [], []
            for p in range(parts):
                at = order[bounds[p] : bounds[p + 1]]
                if not len(at):
                    continue
                own, local = np.unique(row[at], return_inverse=True)
                step = np.arange(count[at].sum()) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
                out_parts.append(p)
                out.append(packed(keys[at], local, begin[at], count[at], distance[at], checks[np.repeat(firsts[at], count[at]) + step], ids[own], tags[own]))
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out_parts, pa.int32()), none, none, pa.array(out, pa.binary())], names=["part", "doc_id", "tag", "value"])

    def look_up(block: pa.Table) -> pa.Table:
        names = ["doc_id", "tag", "value"]
        sent = block.filter(block.column("doc_id").is_null()).column("value")
        out = [block.filter(block.column("doc_id").is_valid()).select(names)]
        if len(sent):
            got = repeated([x.as_buffer() for x in sent])
            del sent, block
            which, place, ref, ref_place = settle(got[0], got[5], *got[1:5])
            if found := spans(got[5][which], got[6][which], place, ref, ref_place):
                out.append(pa.Table.from_batches([found]))
        return pa.concat_tables(out)

    def gather(block: pa.Table) -> pa.Table:
        out = look_up(block)
        B.give_back()
        return out

    sent = docs.select("doc_id", "text", F.crc32(F.col("text").cast("binary")).alias("tag")).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(send, "part int, doc_id bigint, tag bigint, value binary")
    # Kept, so that the index's shuffle is gone before texts are shuffled to meet their spans.
    return cut(sent.groupBy("part").applyInArrow(gather, "doc_id bigint, tag bigint, value binary"))


def parse(runs: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Runs of windows that references have -> the factors (first word, words, reference document, first word there) of a
    greedy parse, and the spans (first word, end) that they cover with the windows over their ends."""
    passages: list[list[int]] = []
    for place, n, ref, ref_place in runs[np.lexsort((runs[:, 2], runs[:, 0]))].tolist():
        if passages and (last := passages[-1])[2] == ref and last[0] + last[1] == place and ref_place - last[3] == place - last[0]:
            last[1] += n
        else:
            passages.append([place, n, ref, ref_place])
    factors: list[tuple[int, int, int, int]] = []
    spans: list[list[int]] = []
    pointer = 0
    for place, n, ref, ref_place in passages:
        end = place + n + window - 1
        if (start := max(place, pointer)) < place + n:
            factors.append((start, end - start, ref, ref_place + start - place))
            pointer = end
        # Windows before the pointer lie over the end of the factor before it.
        if spans and place <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([place, end])
    return factors, [(a, b) for a, b in spans]


def dedup(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, n_factors.

    With ``keep_text`` the columns of ``docs`` come first, the text being what is kept (unchanged if nothing
    goes), and the factors come last. A column of ``docs`` named as one of these gives way to it.
    """
    bound_batches(docs.sparkSession)
    out_names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors"]
    found = duplicate_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), window=window)
    found = found.groupBy("doc_id", "tag").agg(F.collect_list("value").alias("__runs")).withColumnsRenamed({"doc_id": "__id", "tag": "__tag"})
    results = {*out_names[1:], "factors", "__own", "__text", "__runs"}
    docs = docs.drop(*[c for c in docs.columns if keep_text and c.lower() in results and c not in (id_col, text_col)])
    kept_columns = docs.columns if keep_text else []
    own = docs.select(*kept_columns, F.col(id_col).cast("long").alias("__own"), F.col(text_col).alias("__text"))
    meets = (F.col("__own") == F.col("__id")) & (F.crc32(F.col("__text").cast("binary")) == F.col("__tag"))
    rows = own.join(found, meets, "left").select(*kept_columns, "__own", "__text", "__runs")
    schema = "n_words bigint, n_removed bigint, kept_sha256 string, n_factors int"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] if keep_text else ["doc_id bigint"]
    schema = ", ".join([*fields, schema]) + ", factors array<struct<start:bigint,length:bigint,ref_doc:bigint,ref_start:bigint>>" * keep_text
    place, n_kept = (docs.columns.index(text_col) if keep_text else -1), len(kept_columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, n_factors, texts, parsed = [], [], [], [], [], []
            for text, runs in zip(batch.column(n_kept + 1), batch.column(n_kept + 2), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                found, gone_spans = parse(np.concatenate([np.frombuffer(x.as_buffer(), dtype="<i8") for x in runs.values]).reshape(-1, 4), window) if runs.is_valid else ([], [])
                n, kept = len(words), words
                if found:
                    gone = bytearray(n)
                    for at, end in gone_spans:
                        gone[at:end] = b"\1" * (end - at)
                    kept = [w for w, x in zip(words, gone, strict=True) if not x]
                joined = b" ".join(kept)
                n_words.append(n)
                n_removed.append(n - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                n_factors.append(len(found))
                if keep_text:
                    texts.append(joined.decode() if found else text.as_py())
                    parsed.append([dict(zip(("start", "length", "ref_doc", "ref_start"), x, strict=True)) for x in found])
            arrays = batch.columns[:n_kept] if keep_text else [batch.column(0)]
            arrays += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(n_factors, pa.int32())]
            if keep_text:
                arrays[place] = pa.array(texts, pa.string())
                arrays.append(pa.array(parsed, kind))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept_columns, *out_names[1:], "factors"] if keep_text else out_names)

    return rows.mapInArrow(keep, schema)


#: The same by plain SQL: all windows with the smallest document of each; what lies under a later one's goes.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i AS place, array_to_string(words[i:i + 12], ' ') AS passage FROM d, unnest(range(1, len(words) - 11)) AS t(i)),
f AS (SELECT passage, min(doc_id) AS first_doc FROM w GROUP BY passage HAVING count(*) > 1),
g AS (SELECT DISTINCT w.doc_id, w.place + o.o AS place FROM w JOIN f USING (passage), unnest(range(0, 13)) AS o(o) WHERE w.doc_id > f.first_doc),
r AS (SELECT doc_id, list(place) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, len(words) AS n, CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]) END AS kept
      FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document without passages of 13 words that an earlier document has."""
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
