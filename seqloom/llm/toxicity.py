"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly.

A word is the mean of the embeddings of its own bucket and of those of its character n-grams (with marks
at both ends), a text the mean of its words and some blank ones, and a linear softmax over this mean gives the classes. The
embeddings and the softmax are trained together by stochastic gradients in NumPy. A misspelling that was
never seen shares n-grams, so also vectors, with the word it stands for.

The score of a text is linear in its words up to the softmax, so scoring needs one number for each bucket: the difference that it makes to
the two logits. Words and n-grams are cut, hashed and added up for some hundred thousand characters at a time in NumPy; each
distinct word of these is looked up once. Texts are scored whole.

The classifier is fitted on a bounded sample of labelled rows, ``SAMPLE`` of each class at most, by the hash
of their ids; the softmax's bias makes up for the classes' shares. Training runs in one task.

Defined results: null, empty and wordless texts get the score of the bias alone; without labelled rows of
both classes every score is the share of class 1 (0 without any); equal texts get equal scores; null ids are
kept and never train; of rows of equal id each is scored, and each trains; texts are read whole however long they are; other
columns stay as they are, one named as the score gives way to it; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import bound_batches, crc_mod, cut, forget, table

#: Labelled rows of each class that are fitted on, at most.
SAMPLE = {1: 2500, 0: 4500}
BUCKETS, DIMENSIONS = 1 << 20, 8
#: Lengths of character n-grams, counted with the marks at a word's ends: a mark and three letters are the shortest.
GRAMS = (4, 5, 6)
SALT = 0x5851F42D4C957F2D
#: Passes over the sample, and updates at least; rows of an update, and the rate.
EPOCHS, UPDATES, BATCH, RATE = 10, 400, 64, 0.5
#: Size of embeddings at the start; and what Adagrad's sums of squares begin with. Every bucket that is seen counts, but with
#: this damping the vector of a rare one moves in proportion to its gradients, where plain Adagrad would let it tell rows apart.
START, DAMPING = 0.01, 0.005
#: Words of no meaning that every text's mean holds besides its own, lest a few words decide alone.
PADDING = 20
#: Characters that are cut into words at once.
STEP = 1 << 19
_BLANK = re.compile(r"[ \t\n\v\f\r]")


def pieces(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """(stretches of texts, the row of each) in blocks of about STEP characters; a long text is cut at blanks."""
    parts, rows, size = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = at + STEP - size
            if end < len(text):
                blank = _BLANK.search(text, end)
                end = blank.start() if blank else len(text)
            parts.append(text[at:end])
            rows.append(row)
            size += end - at
            at = end
            if size >= STEP:
                yield parts, rows
                parts, rows, size = [], [], 0
    if parts:
        yield parts, rows


def words_of(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part and distinct word of each word; a hash of each distinct word; and (distinct word, bucket) for its own bucket and all its n-grams.

    Words are runs of anything but ASCII white space, in Unicode's lower case, between two marks.
    """
    lowered = [p.lower() for p in parts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    text = (codes != 32) & ((codes < 9) | (codes > 13))
    edge = np.diff(text.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    part = np.searchsorted(np.cumsum([len(p) + 1 for p in lowered]), starts, side="right")
    numbers = B.mix(codes.astype(np.uint64) + np.uint64(SALT))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(numbers * B.powers(B._INVERSE, len(numbers))[: len(numbers)], dtype=np.uint64)])
        hashes = B.mix((sums[ends] - sums[starts]) * B.powers(B._BASE, len(numbers) + 1)[starts] + (ends - starts).astype(np.uint64))
    keys, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    # The distinct words side by side, each between its marks.
    sizes = (ends - starts)[first] + 2
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(keys)), sizes)
    marked = np.full(len(of), B.mix(np.array([SALT], dtype=np.uint64))[0])
    inner = np.ones(len(of), dtype=bool)
    inner[begin] = inner[begin + sizes - 1] = False
    marked[inner] = numbers[(starts[first] - begin - 1)[of[inner]] + np.flatnonzero(inner)]
    left = (begin + sizes)[of] - np.arange(len(of))  # characters from here to the word's end
    owners, buckets = [np.arange(len(keys))], [keys]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        owners.append(of[at])
        buckets.append(B.hash_runs(marked, n)[at] ^ np.uint64(n))
    return part, word, keys, np.concatenate(owners), (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int32)


class Bags:
    """Texts as distinct words with their shares in the text's mean; each word's buckets stand once in one array."""

    def __init__(self, texts: list[str | None]):
        totals, rows, words, counts, sizes, buckets = np.zeros(len(texts)), [], [], [], [], []
        known, numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)  # distinct words by hash, and which came first
        for parts, part_rows in pieces(texts):
            part, word, keys, owner, bucket = words_of(parts)
            row = np.array(part_rows)[part]
            totals += np.bincount(row, minlength=len(texts))
            pair, n = np.unique(row * len(keys) + word, return_counts=True)
            at = np.searchsorted(known, keys)
            new = np.append(known, np.uint64(0))[at] != keys if len(known) else np.ones(len(keys), dtype=bool)
            new |= at == len(known)
            number = np.append(numbers, np.int32(0))[at]
            number[new] = len(known) + np.arange(new.sum())
            known, numbers = np.insert(known, at[new], keys[new]), np.insert(numbers, at[new], number[new])
            rows.append((pair // max(1, len(keys))).astype(np.int32))
            words.append(number[pair % max(1, len(keys))])
            counts.append(n.astype(np.int32))
            mine = np.flatnonzero(new[owner])
            mine = mine[np.argsort(owner[mine], kind="stable")]
            sizes.append(np.bincount(owner[mine], minlength=len(keys))[new])
            buckets.append(bucket[mine])
        join = lambda x, kind: np.concatenate([np.zeros(0, dtype=kind), *x])
        place = np.empty(len(known), dtype=np.int32)
        place[numbers] = np.arange(len(known), dtype=np.int32)
        self.begin = np.concatenate([[0], np.cumsum(join(sizes, np.int64)[numbers])])
        self.buckets, done = np.empty(self.begin[-1], dtype=np.int32), 0
        for k, n in enumerate(sizes):  # block by block, so that no index of all n-grams is made
            to = self.begin[place[done : done + len(n)]]
            self.buckets[np.repeat(to - (np.cumsum(n) - n), n) + np.arange(n.sum())] = buckets[k]
            buckets[k], done = None, done + len(n)
        row, word = join(rows, np.int32), place[join(words, np.int32)]  # texts come in their order
        share = (join(counts, np.int32) / (totals[row] + PADDING)).astype(np.float32)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        self.rows = [(word[a:b], share[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _sum(which: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``which``, 0 to n - 1."""
    return np.stack([np.bincount(which, weights=values[:, d], minlength=n) for d in range(values.shape[1])], axis=1)


def fit(known: Bags, labels: np.ndarray, weights: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings (BUCKETS, DIMENSIONS; unseen buckets 0), softmax weights (DIMENSIONS, 2) and bias (2), by Adagrad."""
    bags, begin = known.rows, known.begin
    place = np.zeros(BUCKETS, dtype=np.int32)
    place[known.buckets] = 1
    seen = np.flatnonzero(place)
    place[seen] = np.arange(len(seen))
    rng = np.random.Generator(np.random.PCG64(seed))
    scale = np.float32(8)  # of a text's mean, so that rates of usual size move it
    emb = (rng.random((len(seen), DIMENSIONS), dtype=np.float32) - 0.5) * np.float32(START / DIMENSIONS)
    soft = rng.normal(size=(DIMENSIONS, 2)) / 2
    bias = np.log(np.array([max(weights[labels == c].sum(), 1e-9) for c in (0, 1)]) / weights.sum())
    emb_sq, soft_sq = np.full((len(emb), 1), DAMPING, dtype=np.float32), np.full((DIMENSIONS, 2), 1e-6)
    batches = -(-len(bags) // BATCH)
    for _ in range(max(EPOCHS, -(-UPDATES // batches))):
        for at in np.array_split(rng.permutation(len(bags)), batches):
            words = np.concatenate([bags[i][0] for i in at])
            if not len(words):
                continue
            shares = np.concatenate([bags[i][1] for i in at]) * scale
            rows = np.repeat(np.arange(len(at)), [len(bags[i][0]) for i in at])
            words, word = np.unique(words, return_inverse=True)
            sizes = (begin[words + 1] - begin[words])[:, None]
            of = np.repeat(np.arange(len(words)), sizes[:, 0])
            ids = place[known.buckets[begin[words][of] + np.arange(len(of)) - (np.cumsum(sizes) - sizes[:, 0])[of]]]
            vectors = _sum(of, emb[ids], len(words)) / sizes
            hidden = _sum(rows, vectors[word] * shares[:, None], len(at))
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), labels[at]] -= 1
            p *= (weights[at] / weights.mean())[:, None]
            to_soft, to_hidden = hidden.T @ p / len(at), p @ soft.T
            soft_sq += to_soft**2
            soft -= RATE * to_soft / np.sqrt(soft_sq)
            to_words = _sum(word, to_hidden[rows] * shares[:, None], len(words)) / sizes
            distinct, which = np.unique(ids, return_inverse=True)
            step = _sum(which, to_words[of], len(distinct)).astype(np.float32)
            emb_sq[distinct, 0] += (step**2).mean(axis=1)
            emb[distinct] -= np.float32(RATE) * step / np.sqrt(emb_sq[distinct])
    out = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
    out[seen] = emb * scale
    return out, soft, bias


def model(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """(what each bucket adds to the logit of class 1, the bias), fitted in one task on ``labelled``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("toxicity")
        texts, labels, weights = [], [], []
        for batch in batches:
            for column, held in zip(("text", "label", "weight"), (texts, labels, weights), strict=True):
                held += batch.column(column).to_pylist()
        y, w = np.array(labels, dtype=np.int64), np.array(weights, dtype=np.float64)
        if len({*labels}) == 2:
            bags = Bags(texts)
            texts.clear()  # the fit needs much memory and no text
            B.give_back()
            emb, soft, bias = fit(bags, y, w)
            lift, base = emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])
            del bags, emb
            B.give_back()
        else:
            lift, base = np.zeros(BUCKETS), 40.0 if labels and labels[0] == 1 else -40.0
        yield pa.RecordBatch.from_arrays([pa.array([lift.astype("<f4").tobytes()], pa.binary()), pa.array([base], pa.float64())], names=["lift", "base"])

    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.col("weight").cast("double"))
    out = rows.repartition(1).sortWithinPartitions("id", "text").mapInArrow(run, "lift binary, base double").collect()
    if not out:  # no rows, so no task
        return np.zeros(BUCKETS, dtype="<f4"), -40.0
    return np.frombuffer(bytes(out[0]["lift"]), dtype="<f4"), out[0]["base"]


def logits(texts: list[str | None], lift: np.ndarray, base: float) -> np.ndarray:
    """The logit of class 1 of each text: the mean over its words, and some blank ones, of the means of their buckets' parts."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for parts, rows in pieces(texts):
        part, word, keys, owner, bucket = words_of(parts)
        if len(keys):
            value = np.bincount(owner, weights=lift[bucket]) / np.bincount(owner)
            row = np.array(rows)[part]
            total += np.bincount(row, weights=value[word], minlength=len(texts))
            n += np.bincount(row, minlength=len(texts))
    return base + total / (n + PADDING)


def score(docs: DataFrame, lift: np.ndarray, base: float, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in ``score_col``; a column that had this name gives way."""
    docs = docs.drop(score_col)
    bound_batches(docs.sparkSession)
    at, names = docs.columns.index(text_col), [*docs.columns, score_col]
    sent = docs.sparkSession.sparkContext.broadcast(lift)  # BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("toxicity")
        for whole in batches:
            for batch in B.chunks(iter([whole]), at, 4 * STEP):
                z = logits(batch.column(at).to_pylist(), sent.value, base)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=names)

    return docs.mapInArrow(run, docs.withColumn(score_col, F.lit(0.0)).schema)


def sample(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """The labelled rows to fit on: up to SAMPLE of each class, with the weight that each stands for."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    one = cut(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    of = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [one.where(F.col("toxic") == c).orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(most).withColumn("weight", F.lit(max(1.0, of.get(c, 0) / most))) for c, most in SAMPLE.items()]
    chosen = parts[0].unionByName(parts[1])
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most the sum of SAMPLE rows


def trained(spark, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model of every query here: it learns from no row of fold 1 of 3."""
    return model(sample(docs, labels, crc_mod("doc_id", 3) == 1))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: a score for every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), *trained(spark, docs, labels))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
