"""Token ids in files coded by a static range asymmetric numeral system (rANS).

A file is a Parquet row set of segments. A segment holds about SEGMENT ids of whole documents under one shared
frequency table; its blocks of BLOCK ids are coded independently, each by LANES interleaved coder states. A
block stores its final states, and at every CHECKPOINT rows of lanes the states and the position in its words,
so that a reader can start there; and the CRC-32 of its words and of its ids.

    block: uint32 ids, words, checkpoints, crc of words, crc of ids | checkpoints: uint32 position,
           LANES uint64 states | LANES uint64 final states | uint32 words

Documents are in ascending doc_id order over all files and segments, null ids first; rows of equal ids are in the order
in which they were read. Where a document ends stands beside the blocks: the end id may be one of a text's own. Null texts
are empty: their only id is the end id. Repeated rows are coded once each. An empty table gives no segments. Other
columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import batches, stage
from quillspark.llm.token_ids import encoder, tokenizer_path

SEGMENT, BLOCK, LANES, CHECKPOINT = 1 << 21, 1 << 20, 4096, 64
#: Frequencies add up to 1 << SCALE; states stay in [LOW, LOW << 32).
SCALE = 20
LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_SCALE = np.uint64(SCALE)
_MASK = np.uint64((1 << SCALE) - 1)

SEGMENT_SCHEMA = "file int, segment int, first long, n_ids long, doc_ids array<long>, sizes array<long>, table binary, blocks array<binary>"


class Corrupt(ValueError):
    """A checksum does not match."""


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, and their scaled frequencies (1 at least, 1 << SCALE in all)."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    n = counts[symbols].astype(np.float64)
    total = 1 << SCALE
    scaled = np.maximum(1, np.floor(n * (total / n.sum()))).astype(np.int64)
    off = total - int(scaled.sum())
    if off > 0:
        scaled[np.argmax(scaled)] += off
    while off < 0:  # rounding up rare ids took too much: take it from the frequent ones
        take = np.argsort(-scaled, kind="stable")[: max(1, len(scaled) // 8)]
        share = np.minimum(scaled[take] - 1, -(off // len(take)))
        room = np.cumsum(share)
        share = np.where(room <= -off, share, np.maximum(0, share - (room + off)))
        scaled[take] -= share
        off += int(share.sum())
    return symbols.astype(np.uint32), scaled.astype(np.uint32)


def pack_table(symbols: np.ndarray, freq: np.ndarray) -> bytes:
    gaps = np.diff(symbols.astype(np.int64), prepend=0).astype("<u4")
    return struct.pack("<I", len(symbols)) + zlib.compress(gaps.tobytes() + freq.astype("<u4").tobytes(), 1)


def unpack_table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    both = np.frombuffer(zlib.decompress(data[4:]), "<u4")
    return np.cumsum(both[:n].astype(np.int64)).astype(np.uint32), both[n:].copy()


def encode_block(ids: np.ndarray, freq: np.ndarray, base: np.ndarray) -> bytes:
    """freq, base: by id. Codes from the last row of lanes to the first; words are kept in reading order."""
    n = len(ids)
    rows = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    limit = np.uint64((int(LOW) >> SCALE) << 32)
    for r in range(rows - 1, -1, -1):
        own = ids[r * LANES : (r + 1) * LANES]
        x, f = state[: len(own)], freq[own]
        full = x >= limit * f
        if full.any():
            out.append(x[full].astype(np.uint32))
            written += len(out[-1])
            x = np.where(full, x >> _WORD, x)
        q = x // f
        state[: len(own)] = (q << _SCALE) + (x - q * f) + base[own]
        if r and r % CHECKPOINT == 0:
            marks.append((written, state.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    body = words.astype("<u4").tobytes()
    head = struct.pack("<5I", n, len(words), len(marks), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes()))
    saved = b"".join(struct.pack("<I", written - at) + s.astype("<u8").tobytes() for at, s in reversed(marks))
    return head + saved + state.astype("<u8").tobytes() + body


def decode_block(data: bytes, slots: np.ndarray, freq: np.ndarray, base: np.ndarray, symbols: np.ndarray, start: int = 0) -> np.ndarray:
    """The block's ids; start: from that checkpoint on (0: its beginning)."""
    n, n_words, n_marks, crc, crc_ids = struct.unpack_from("<5I", data)
    mark = 4 + 8 * LANES
    states_at = 20 + n_marks * mark
    body = memoryview(data)[states_at + 8 * LANES :]
    if zlib.crc32(body) != crc:
        raise Corrupt("words of a block")
    words = np.frombuffer(body, "<u4").astype(np.uint64)
    row, at = start * CHECKPOINT, 0
    if start:
        where = 20 + (start - 1) * mark
        (at,) = struct.unpack_from("<I", data, where)
        state = np.frombuffer(data, "<u8", LANES, where + 4).copy()
    else:
        state = np.frombuffer(data, "<u8", LANES, states_at).copy()
    out = np.empty(n - row * LANES, np.uint32)
    for r in range(row, -(-n // LANES)):
        k = min(LANES, n - r * LANES)
        x = state[:k]
        low = x & _MASK
        s = slots[low.astype(np.int64)]
        out[(r - row) * LANES : (r - row) * LANES + k] = symbols[s]
        x = freq[s] * (x >> _SCALE) + low - base[s]
        short = x < LOW
        m = int(np.count_nonzero(short))
        if m:
            x[short] = (x[short] << _WORD) | words[at : at + m]
            at += m
        state[:k] = x
    if not start and zlib.crc32(out.astype("<u4").tobytes()) != crc_ids or at != n_words:
        raise Corrupt("ids of a block")
    return out


def encode_ids(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """Table and blocks of a segment."""
    symbols, scaled = frequencies(ids)
    freq = np.zeros(int(symbols[-1]) + 1, np.uint64)
    base = freq.copy()
    freq[symbols] = scaled
    base[symbols] = np.cumsum(scaled, dtype=np.uint64) - scaled
    return pack_table(symbols, scaled), [encode_block(ids[i : i + BLOCK], freq, base) for i in range(0, len(ids), BLOCK)]


def decode_ids(table: bytes, blocks: list[bytes]) -> np.ndarray:
    symbols, scaled = unpack_table(table)
    slots = np.repeat(np.arange(len(symbols), dtype=np.int32), scaled)
    freq = scaled.astype(np.uint64)
    base = np.cumsum(freq) - freq
    return np.concatenate([decode_block(b, slots, freq, base, symbols) for b in blocks])


def write_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Codes all texts of docs (doc_id, text) into segments, one file for each range of doc_id."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(path, True).encode
        file = TaskContext.get().partitionId()
        first = segment = 0
        held: list[np.ndarray] = []
        keys: list = []
        sizes: list[int] = []
        schema = pa.schema([("file", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("table", pa.binary()), ("blocks", pa.list_(pa.binary()))])

        def flush():
            nonlocal first, segment
            ids = np.concatenate(held)
            table, blocks = encode_ids(ids)
            row = {"file": file, "segment": segment, "first": first, "n_ids": len(ids), "doc_ids": keys, "sizes": sizes, "table": table, "blocks": blocks}
            first, segment = first + len(ids), segment + 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches(rows):
            ids_of, texts = zip(*batch, strict=True)
            ids, n = encode([t or "" for t in texts])
            held.append(ids)
            keys += ids_of
            sizes += n.tolist()
            if sum(map(len, held)) >= SEGMENT:
                yield flush()
                held, keys, sizes = [], [], []
        if held:
            yield flush()

    # rows that repeat a doc_id, or have none, are told apart by their place: no file has to hold all of them
    placed = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    return stage(ordered.mapInArrow(run, SEGMENT_SCHEMA), "token-ids")


def read_ids(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the segments' blocks."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in rows:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw = memoryview(decode_ids(row["table"], row["blocks"]).astype("<u4").tobytes())
                ends = np.cumsum(row["sizes"])
                starts = ends - row["sizes"]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(crc), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(crc, pa.int64())], ["file", "doc_id", "own_start", "n_tokens", "ids_crc32"])

    read = segments.select("file", "first", "doc_ids", "sizes", "table", "blocks").mapInArrow(run, "file int, doc_id long, own_start long, n_tokens long, ids_crc32 long")
    # one row for each file: the ids of the files before it
    before = segments.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return read.join(before, "file").select("doc_id", (F.col("before") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")
