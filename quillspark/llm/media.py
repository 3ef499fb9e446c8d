"""Media columns: what a binary value really is, found by its magic bytes and confirmed by its structure.

An Aho-Corasick automaton finds all magic bytes in one pass; at each hit a validator of that format walks the
structure (chunk sizes, trailers, checksums) and tells the length, or that there is none. A value whose valid
medium starts at 0 and fills it has that type, whatever type was declared; valid media at other places are
carved out as (type, offset, length). What validators look for further on is found once for each value.

Null values and empty ones hold no media: their type is the declared one if that is no format known here, else
octets. A null text is stored like an empty one. Of two media that overlap the one that begins first counts, of two that
begin together the one whose magic bytes end first. Repeated rows give repeated rows, equal texts equal values; doc_id may
be null. An empty table gives an empty one. sniffed() passes extra columns of any name on, but for true_type and embedded,
which it replaces; the others leave them out.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import batches, field, quoted, stage

UNIT = 192
PAD = b"\x20"
RATE = 8000
OCTETS, TEXT = "application/octet-stream", "text/plain"


def wav_of(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit mono samples in a RIFF/WAVE container."""
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def _riff(data: bytes, at: int, known: dict) -> int:
    """Length of a RIFF/WAVE with a format and a data chunk, 0 if it is none."""
    if data[at + 8 : at + 12] != b"WAVE" or len(data) < at + 44:
        return 0
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return 0
    i, seen = at + 12, set()
    while i + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, i)
        if name == b"fmt " and size < 16:
            return 0
        seen.add(name)
        i += 8 + size + (size & 1)
    return end - at if i == end and {b"fmt ", b"data"} <= seen else 0


def wav_payload(data: bytes, at: int = 0) -> memoryview:
    """Samples of the first data chunk of a valid RIFF/WAVE."""
    i = at + 12
    while True:
        name, size = struct.unpack_from("<4sI", data, i)
        if name == b"data":
            return memoryview(data)[i + 8 : i + 8 + size]
        i += 8 + size + (size & 1)


def _png(data: bytes, at: int, known: dict) -> int:
    i, first = at + 8, True
    while i + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, i)
        if i + 12 + size > len(data) or first and (name, size) != (b"IHDR", 13):
            return 0
        if zlib.crc32(data[i + 4 : i + 8 + size]) != struct.unpack_from(">I", data, i + 8 + size)[0]:
            return 0
        first, i = False, i + 12 + size
        if name == b"IEND":
            return i - at
    return 0


def _sub_blocks(data: bytes, at: int, ends: dict[int, int]) -> int:
    """Where the chain of sub-blocks at at ends; a value's chains meet, and each is walked once."""
    seen = []
    while at not in ends and at < len(data) and data[at]:
        seen.append(at)
        at += data[at] + 1
    end = ends.get(at, at + 1)
    ends.update(dict.fromkeys([*seen, at], end))
    return end


def _gif(data: bytes, at: int, known: dict) -> int:
    if data[at + 4 : at + 6] not in (b"7a", b"9a") or len(data) < at + 14:
        return 0
    flags = data[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while i < len(data):
        kind = data[i]
        if kind == 0x3B:
            return i + 1 - at
        if kind == 0x21:
            i += 2
        elif kind == 0x2C and i + 10 < len(data):
            flags = data[i + 9]
            i += 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        else:
            return 0
        i = _sub_blocks(data, i, known.setdefault("gif", {}))
    return 0


def _jpeg(data: bytes, at: int, known: dict) -> int:
    i = at + 2
    while i + 4 <= len(data) and data[i] == 0xFF:
        kind = data[i + 1]
        if kind in (0xFF, 0x00, 0xD8) or 0xD0 <= kind <= 0xD7:
            return 0
        size = struct.unpack_from(">H", data, i + 2)[0]
        if size < 2:
            return 0
        i += 2 + size
        if kind == 0xDA:  # entropy-coded bytes up to the next marker that isn't stuffed or a restart
            while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data):
                if data[i + 1] == 0xD9:
                    return i + 2 - at
                if data[i + 1] and not 0xD0 <= data[i + 1] <= 0xD7:
                    break
                i += 2
            if i < 0:
                return 0
    return 0


def _bmp(data: bytes, at: int, known: dict) -> int:
    if len(data) < at + 30:
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", data, at + 2)
    planes, bits = struct.unpack_from("<HH", data, at + 26)
    good = not zero and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= offset <= size
    return size if good and at + size <= len(data) else 0


_PDF_PARTS = re.compile(rb"%PDF-[0-9]|startxref|%%EOF")


def _pdf(data: bytes, at: int, known: dict) -> int:
    """Up to the last end mark that a startxref of its own precedes, before the next header: updates are appended."""
    if "pdf" not in known:
        known["pdf"] = ends = {}
        header, pending = -1, False
        for m in _PDF_PARTS.finditer(data):
            if m[0].startswith(b"%PDF"):
                header, pending = m.start(), False
            elif m[0] == b"startxref":
                pending = True
            elif header >= 0 and pending:
                ends[header], pending = m.end(), False
    return known["pdf"].get(at, at) - at


#: Fixed values of the formats: magic bytes, type, validator.
FORMATS: dict[bytes, tuple[str, Callable[[bytes, int, dict], int]]] = {
    b"RIFF": ("audio/wav", _riff),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF8": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"BM": ("image/bmp", _bmp),
    b"%PDF-": ("application/pdf", _pdf),
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in FORMATS:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(data: bytes | None) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all valid media in data, by offset; media inside one already found are left out."""
    out, free, known = [], 0, {}
    if not data:
        return out
    data = bytes(data)
    for last, magic in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - len(magic)
        if at >= free:
            kind, length = FORMATS[magic][0], FORMATS[magic][1](data, at, known)
            if length:
                out.append((kind, at, length))
                free = at + length
    return out


def media_type(data: bytes | None, declared: str | None, found: list[tuple[str, int, int]] | None = None) -> str:
    """The confirmed type of a value; without one, its declared type unless that is a format known here. found: what sniff() finds."""
    found = sniff(data) if found is None else found
    if found and found[0][1:] == (0, len(data or b"")):
        return found[0][0]
    return OCTETS if not declared or declared in {t for t, _ in FORMATS.values()} else declared


EMBEDDED = "array<struct<type:string,start:bigint,bytes:binary>>"


def sniffed(df: DataFrame, column: str = "media", declared: str = "media_type") -> DataFrame:
    """df with true_type, and embedded: the media carved out of values that are none themselves."""
    kept = [c for c in df.columns if c.lower() not in ("true_type", "embedded")]
    said = quoted(declared) if declared in df.columns else F.lit(None)

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("bytes", pa.binary())]))
        for batch in rows:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                types, cut = [], []
                for data, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = sniff(data)
                    types.append(media_type(data, name, found))
                    cut.append([{"type": k, "start": at, "bytes": data[at : at + n]} for k, at, n in found if (at, n) != (0, len(data))])
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(types, pa.string()), pa.array(cut, kind)], ["doc", "true_type", "embedded"])

    packed = df.select(quoted(column).cast("binary").alias("value"), said.cast("string").alias("said"), F.struct(*map(quoted, kept)).alias("doc"))
    looked = packed.mapInArrow(run, T.StructType([packed.schema["doc"], T.StructField("true_type", T.StringType()), T.StructField("embedded", T._parse_datatype_string(EMBEDDED))]))
    return looked.select(*[field("doc", c) for c in kept], "true_type", "embedded")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_type, media: each text's UTF-8, padded to a positive multiple of UNIT, as 8-bit samples; written out.

    media_type is what the texts were declared as, which the stored form no longer is."""
    raw = F.coalesce(F.encode(F.col("text"), "utf-8"), F.lit(b""))
    size = F.octet_length(raw)

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches(rows, text=2):
            ids, sizes, raw = zip(*batch, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([wav_of(x.ljust(max(1, -(-len(x) // UNIT)) * UNIT, PAD)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long"), size.cast("long").alias("n_bytes"), raw.alias("raw"))
    return stage(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary").withColumn("media_type", F.lit(TEXT)), "media")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(stored: DataFrame) -> DataFrame:
    """FEATURES of stored media (doc_id, n_bytes, media, media_type).

    feature: declared and corrected type, the medium's place, sample count, sum of samples, and media that sniffing finds in the samples."""

    def run(rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = [c.split()[0] for c in FEATURES.split(", ")]
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches(rows, text=2):
            out = []
            for key, size, media, declared in batch:
                found = sniff(media)
                kind, at, length = next(iter(found), (OCTETS, 0, 0))
                samples = wav_payload(media, at) if kind == "audio/wav" else memoryview(b"")
                inner = sniff(bytes(samples))
                feature = f"{declared}>{media_type(media, declared, found)}@{at}+{length};samples={len(samples)};sum={int(np.frombuffer(samples, np.uint8).sum(dtype=np.int64))};embedded=" + ",".join(f"{k}@{i}+{n}" for k, i, n in inner)
                out.append((key, size, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return stored.select("doc_id", "n_bytes", "media", "media_type").mapInArrow(run, FEATURES)
