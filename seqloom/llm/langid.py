"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds those of its letters: each is
permuted (rotated) once for every place it stands before the last, and they are multiplied. A text's
vector bundles (adds) those of its n-grams, a language's prototype bundles its training texts, and a text
is given the language whose prototype has the largest cosine with it. Runs of other characters count as
one blank, which has a vector as a letter does.

Bundling is linear, so prototypes are added up by tasks over all training texts in whole numbers: the
result doesn't depend on how rows are dealt, and each task sends one vector a language.

Defined results: ``und`` with score 0 for null text, for text without a letter, and if nothing could be
learned; cosines below 0 score 0; ties go to the first language by code point; equal rows get equal
results; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, memory, table

#: Letters of an n-gram, and dimensions of a vector.
N, DIMENSIONS = 3, 512
#: Characters of a block of texts, and n-grams of which counts are multiplied at once.
BLOCK, PIECE = 400_000, 100_000
#: n-grams whose vectors a worker keeps, and bits of the number of slots in which they are looked up.
REMEMBERED, SLOT_BITS = 100_000, 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Encoder:
    """Vectors of n-grams, made when first met; a worker keeps them, each in the place it was given then."""

    def __init__(self, n: int = N, dimensions: int = DIMENSIONS, seed: int = 5):
        self.n, self.dimensions, self.seed = n, dimensions, seed
        self.symbols = np.zeros(0x110000, dtype=np.int32)  # 0: not met; 1: blank
        self.letters: list[np.ndarray] = [self._random(0), self._random(0)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.vectors = np.zeros((1024, self.dimensions), dtype=np.int8)
        self.slot_grams = np.full(1 << SLOT_BITS, -1, dtype=np.int64)  # the n-gram last looked up in a slot, and its place
        self.slot_places = np.zeros(1 << SLOT_BITS, dtype=np.int32)

    def _random(self, code: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        out = self.symbols[codes]
        if not out.all():
            for code in np.unique(codes[out == 0]):
                if chr(code).isalpha():
                    self.letters.append(self._random(int(code)))
                    self.symbols[code] = len(self.letters) - 1
                else:
                    self.symbols[code] = 1
            out = self.symbols[codes]
        return out

    def _ngrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and code of every n-gram; whether each row has a letter."""
        joined = " ".join(texts) + " "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        x = self._symbols(codes)
        rows = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        keep = np.ones(len(x), dtype=bool)
        keep[1:] = (x[1:] != 1) | (x[:-1] != 1) | (rows[1:] != rows[:-1])
        x, rows = x[keep].astype(np.int64), rows[keep]
        lettered = np.bincount(rows[x > 1], minlength=len(texts)) > 0
        n = len(x) - self.n + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), lettered
        grams = np.zeros(n, dtype=np.int64)
        for i in range(self.n):
            grams = grams << 20 | x[i : i + n]
        same = rows[:n] == rows[self.n - 1 :]
        return rows[:n][same], grams[same], lettered

    def _bind(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dimensions), dtype=np.int8)
        for i in range(self.n):
            back = self.n - 1 - i
            letters, which = np.unique(grams >> 20 * back & 0xFFFFF, return_inverse=True)
            out *= np.roll(np.stack([self.letters[x] for x in letters]), back, axis=1)[which]
        return out

    def _learn(self, grams: np.ndarray) -> None:
        """Vectors for n-grams that have none: each is written once, and those that are there stay where they are."""
        first = len(self.known)
        if first + len(grams) > len(self.vectors):
            more = max(len(self.vectors), first + len(grams) - len(self.vectors))
            self.vectors = np.concatenate([self.vectors, np.zeros((more, self.dimensions), dtype=np.int8)])
        self.vectors[first : first + len(grams)] = self._bind(grams)
        self.known.update(zip(grams.tolist(), range(first, first + len(grams)), strict=True))

    def _places(self, grams: np.ndarray) -> np.ndarray:
        """Where the vector of each n-gram is; n-grams that share a slot are told apart, and the one last met has it."""
        slot = (grams.view(np.uint64) * _ODD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        missed = np.flatnonzero(self.slot_grams[slot] != grams)
        if len(missed):
            distinct, which = np.unique(grams[missed], return_inverse=True)
            new = np.array([g for g in distinct.tolist() if g not in self.known], dtype=np.int64)
            if len(new) and len(self.known) + len(new) > REMEMBERED and self.known:  # scripts with many letters: begin anew
                self._forget()
                return self._places(grams)
            if len(new):
                self._learn(new)
            places = np.array([self.known[g] for g in distinct.tolist()], dtype=np.int32)
            out = self.slot_places[slot]
            out[missed] = places[which]
            self.slot_grams[slot[missed]] = grams[missed]
            self.slot_places[slot[missed]] = out[missed]
            return out
        return self.slot_places[slot]

    def bundle(self, texts: list[str], groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A vector for each text, exact whole numbers, and whether it has a letter; with ``groups``, the
        number of each text's group, a vector for each group: that of its n-grams as if they were one text's."""
        rows, grams, lettered = self._ngrams(texts)
        if groups is not None:
            rows = groups[rows]
        count = len(texts) if groups is None else int(groups.max(initial=-1)) + 1
        kind = np.float32 if len(grams) < 1 << 24 else np.float64  # whole numbers stay exact
        out = np.zeros((count, self.dimensions), dtype=kind)
        for at in range(0, len(grams), PIECE):
            places, row = self._places(grams[at : at + PIECE]), rows[at : at + PIECE]
            first, last = row.min(), row.max()
            distinct = np.flatnonzero(np.bincount(places, minlength=len(self.known)))
            column = np.zeros(len(self.known), dtype=np.int64)
            column[distinct] = np.arange(len(distinct))
            shape = (last - first + 1, len(distinct))
            counts = np.bincount((row - first) * shape[1] + column[places], minlength=shape[0] * shape[1])
            out[first : last + 1] += counts.reshape(shape).astype(kind) @ self.vectors[distinct].astype(kind)
        return out, lettered


def encoder() -> Encoder:
    """The worker's memory of n-grams."""
    return memory("langid", None, Encoder)


def blocks(texts: list) -> Iterator[list[int]]:
    """Row numbers in blocks of some characters, so that one matrix stays small."""
    out, size = [], 0
    for i, text in enumerate(texts):
        out.append(i)
        size += len(text or "") + 1
        if size >= BLOCK or len(out) >= 128:
            yield out
            out, size = [], 0
    if out:
        yield out


def train(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language -> unit prototype of all ``rows`` with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = encoder(), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in blocks(texts):
                here: dict[str, int] = {}
                groups = np.array([here.setdefault(langs[i], len(here)) for i in at])
                vectors, _ = known.bundle([texts[i] for i in at], groups)  # n-grams are counted by language and multiplied once
                for vector, lang in zip(vectors.astype(np.int64), here, strict=True):
                    sums[lang] = sums[lang] + vector if lang in sums else vector
        places = range(known.dimensions)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * known.dimensions), pa.array(places, pa.int32()), pa.array(vector, pa.int64())], names=["lang", "place", "value"])

    usable = rows.select(F.col(text_col), F.col(lang_col)).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sums = usable.mapInArrow(run, "lang string, place int, value bigint").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # one vector a language
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["place"]] = r["value"]
    return {lang: v / norm for lang, v in sorted(out.items()) if (norm := np.linalg.norm(v))}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, margin (to the second language) for every whole text."""
    langs = list(prototypes)
    matrix = np.stack([prototypes[x] for x in langs], axis=1) if langs else np.zeros((DIMENSIONS, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores, margins = [], [], []
            for at in blocks(texts):
                vectors, lettered = known.bundle([texts[i] or "" for i in at])
                cosines = (vectors.astype(np.float64) @ matrix) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                for row, ok in zip(cosines, lettered, strict=True):
                    best = int(np.argmax(row)) if ok and langs else -1
                    names.append(langs[best] if best >= 0 else "und")
                    scores.append(float(min(1.0, max(0.0, row[best]))) if best >= 0 else 0.0)
                    margins.append(float(row[best] - np.partition(row, -2)[-2]) if best >= 0 and len(langs) > 1 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], names=["doc_id", "lang_pred", "score", "margin"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id bigint, lang_pred string, score double, margin double")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the language of every document, learned from those outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    learn = docs.where(~held_out & F.col("lang").isNotNull())
    found = predict(docs, train(learn))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin")
