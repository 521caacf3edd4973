"""Signature sniffing of media columns: what a binary value is, whatever its declared type says.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over the value. Each hit
is only a candidate: the format's validator walks the structure (chunks, check sums, lengths) and gives
the length of the medium, or rejects it. A medium that begins at byte 0 is the value's real type and
corrects the declared one; media further on are carved as embedded ones, outermost first. Trailers are searched for once a value, so
a text full of false starts takes time in proportion to its length.

Defined results: a null value has no type and no media; a value without a valid medium keeps its declared
type; equal values give equal results, and repeated rows are rows of their own; values are read whole however long they are; columns
named as a result column give way to it, others stay; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table


class Trailers:
    """Where a value's trailers stand, each searched for once: many false starts don't search the value again."""

    def __init__(self, value: bytes):
        self.value, self.ends, self.marks = value, {}, {}

    def last(self, mark: bytes) -> int:
        if mark not in self.ends:
            self.ends[mark] = self.value.rfind(mark)
        return self.ends[mark]

    def after(self, mark: bytes, at: int) -> int:
        """Where ``mark`` first stands from ``at`` on, -1 if nowhere; starts come in ascending order."""
        known = self.marks.get(mark, -2)
        if known == -2 or 0 <= known < at:
            known = self.marks[mark] = self.value.find(mark, at)
        return known

    def directories(self) -> dict[int, int]:
        """Ends of zip archives by where they begin, as their closing records say."""
        if "zip" not in self.ends:
            b, found, end = self.value, {}, self.value.find(b"PK\x05\x06")
            while end >= 0 and end + 22 <= len(b):
                size, start, note = struct.unpack_from("<IIH", b, end + 12)
                if end + 22 + note <= len(b) and (at := end - size - start) >= 0 and b[at + start : at + start + 4] == b"PK\x01\x02":
                    found.setdefault(at, end + 22 + note)
                end = b.find(b"PK\x05\x06", end + 1)
            self.ends["zip"] = found
        return self.ends["zip"]


def _png(b: bytes, at: int, known: Trailers) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, p)
        kind = b[p + 4 : p + 8]
        if p + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        first, p = False, p + 12 + n
        if kind == b"IEND":
            return p - at
    return None


def _blocks(b: bytes, p: int) -> int | None:
    while p < len(b):
        n = b[p]
        p += 1 + n
        if not n:
            return p
    return None


def _gif(b: bytes, at: int, known: Trailers) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p: int | None = at + 13 + (3 * (2 << (flags & 7)) if flags & 0x80 else 0)
    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = _blocks(b, p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = _blocks(b, p + 11 + (3 * (2 << (local & 7)) if local & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int, known: Trailers) -> int | None:
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at if frame else None
        (n,) = struct.unpack_from(">H", b, p + 2)
        if n < 2:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:  # coded data: to the next marker that is neither stuffing nor a restart
            while p + 1 < len(b) and not (b[p] == 0xFF and b[p + 1] != 0 and not 0xD0 <= b[p + 1] <= 0xD7):
                p += 1
    return p + 2 - at if frame and b[p : p + 2] == b"\xff\xd9" else None


def _riff(kind: bytes):
    def check(b: bytes, at: int, known: Trailers) -> int | None:
        if at + 12 > len(b) or b[at + 8 : at + 12] != kind:
            return None
        (n,) = struct.unpack_from("<I", b, at + 4)
        end, p, seen = at + 8 + n, at + 12, []
        if end > len(b):
            return None
        while p + 8 <= end:
            seen.append(b[p : p + 4])
            p += 8 + (m := struct.unpack_from("<I", b, p + 4)[0]) + (m & 1)
        return end - at if p == end and seen and (kind != b"WAVE" or {b"fmt ", b"data"} <= {*seen}) else None

    return check


def _bmp(b: bytes, at: int, known: Trailers) -> int | None:
    if at + 26 > len(b):
        return None
    n, zero, start, header = struct.unpack_from("<IIII", b, at + 2)
    return n if not zero and header in (12, 40, 108, 124) and 14 + header <= start <= n <= len(b) - at else None


def _pdf(b: bytes, at: int, known: Trailers) -> int | None:
    end, table_at = known.last(b"%%EOF"), known.after(b"startxref", at)
    return end + 5 - at if end >= at and 0 <= table_at < end else None


def _gzip(b: bytes, at: int, known: Trailers) -> int | None:
    one = zlib.decompressobj(31)
    try:
        for p in range(at, len(b), 65536):
            while one.decompress(one.unconsumed_tail or b[p : p + 65536], 1 << 20) and one.unconsumed_tail:
                pass
            if one.eof:
                return min(p + 65536, len(b)) - len(one.unused_data) - at
    except zlib.error:
        pass
    return None


def _zip(b: bytes, at: int, known: Trailers) -> int | None:
    end = known.directories().get(at)
    return end - at if end else None


def _ogg(b: bytes, at: int, known: Trailers) -> int | None:
    p = at
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        n = b[p + 26]
        body = sum(b[p + 27 : p + 27 + n])
        if p + 27 + n + body > len(b):
            return None
        last, p = b[p + 5] & 4, p + 27 + n + body
        if last:
            return p - at
    return None


#: Magic bytes -> the type they announce and what confirms it. Fixed values of the formats.
FORMATS = {
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"RIFF": ("audio/wav", _riff(b"WAVE")),
    b"BM": ("image/bmp", _bmp),
    b"%PDF-": ("application/pdf", _pdf),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"PK\x03\x04": ("application/zip", _zip),
    b"OggS": ("audio/ogg", _ogg),
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in FORMATS:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def candidates(value: bytes, find) -> list[tuple[int, bytes]]:
    """Where magic bytes stand, in order: one pass of the automaton."""
    return sorted((end + 1 - len(magic), magic) for end, magic in find.iter(value.decode("latin-1")))


def confirm(value: bytes, hits: list[tuple[int, bytes]]) -> list[tuple[int, int, str]]:
    """The media at ``hits``: (offset, length, type), outermost first, none inside another."""
    out: list[tuple[int, int, str]] = []
    known = Trailers(value)
    for at, magic in hits:
        if out and at < out[-1][0] + out[-1][1]:
            continue
        kind, check = FORMATS[magic]
        if n := check(value, at, known):
            out.append((at, n, kind))
    return out


def sniff(value: bytes, find) -> list[tuple[int, int, str]]:
    return confirm(value, candidates(value, find))


def sniff_column(df: DataFrame, content_col: str = "content", declared_col: str = "declared") -> DataFrame:
    """``df`` with ``media_type`` (corrected), ``corrected`` and ``media`` (offset, length, type, the carved bytes)."""
    from pyspark.sql import types as T

    df = df.drop(*[c for c in df.columns if c.lower() in ("media_type", "corrected", "media") and c not in (content_col, declared_col)])
    medium = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType()), T.StructField("content", T.BinaryType())])
    schema = T.StructType([*df.schema.fields, T.StructField("media_type", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("media", T.ArrayType(medium))])
    kinds = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for batch in batches:
            types, fixed, carved = [], [], []
            for value, said in zip(batch.column(content_col).to_pylist(), batch.column(declared_col).to_pylist(), strict=True):
                media = sniff(bytes(value), find) if value is not None else []
                real = media[0][2] if media and media[0][0] == 0 else said
                types.append(real)
                fixed.append(real != said)
                carved.append([{"offset": at, "length": n, "type": kind, "content": bytes(value[at : at + n])} for at, n, kind in media])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(carved, kinds)], names=[*batch.schema.names, "media_type", "corrected", "media"])

    return df.mapInArrow(run, schema)


RATE = 8000


def to_wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono PCM; an even number of samples needs no padding."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(samples), b"WAVE") + form + struct.pack("<4sI", b"data", len(samples)) + samples


def from_wav(value: bytes) -> bytes:
    """The samples of a validated file."""
    p = 12
    while value[p : p + 4] != b"data":
        n = struct.unpack_from("<I", value, p + 4)[0]
        p += 8 + n + (n & 1)
    return value[p + 8 : p + 8 + struct.unpack_from("<I", value, p + 4)[0]]


def features(value: bytes, find) -> tuple[bytes, str]:
    """What is read back from a stored file: its samples, and a line on what it is and holds."""
    hits = candidates(value, find)
    if confirm(value, hits[:1]) != [(0, len(value), "audio/wav")]:
        raise ValueError("a stored file isn't the valid sound file that was written")
    samples = from_wav(value)
    head = len(value) - len(samples)
    inner = confirm(samples, [(at - head, magic) for at, magic in hits if at >= head])
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    odd = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    level = int(counts @ np.arange(256))
    power = int(counts @ (np.arange(256) - 128) ** 2)
    said = ",".join(f"{kind}@{at}+{n}" for at, n, kind in inner) or "none"
    return samples, f"type=audio/wav;rate={RATE};samples={len(x)};sum={level};power={power};crossings={odd};values={np.count_nonzero(counts)};embedded={said}"


COLUMNS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Each text as a sound file, read back through the sniffer; with ``keep`` the file is a column, ``media``."""
    fields = [*COLUMNS, ("media", pa.binary())] if keep else COLUMNS
    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                wav = to_wav(raw + bytes(-len(raw) % 64 if raw else 64))
                samples, line = features(wav, find)
                row = (doc, len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), line, wav)
                for column, x in zip(rows, row, strict=False):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(rows, fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(id_col, text_col).mapInArrow(run, ", ".join(f"{n} {names[k]}" for n, k in fields))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every text stored as 8-bit samples and read back."""
    return store_texts(table(spark, sf_dir, "documents"))
