"""Best-fit packing of token sequences, certified by lower bounds from dual feasible functions.

Texts become ids (end id included) and are cut into pieces of at most CAPACITY ids only where they are longer.
Pieces are dealt to partitions; each partition packs its own by best-fit decreasing and bounds its bin count
from below. Where bins exceed the bound, the partition gives up its bins with room; all partitions give up
their emptiest bin. What was given up is dealt out again, to fewer partitions, and packed anew, until bounds
and bins agree or ROUNDS have passed. Only lengths and keys travel, never ids.

A null text is an empty one: its only id is the end id. Repeated rows are packed once for each row. doc_id may
be null. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batches, stage
from quillspark.llm.token_ids import encoder, tokenizer_path

CAPACITY = 2048
#: Pieces that one task packs; exchanges after the first packing; free ids that make a bin give its pieces up.
PER_TASK, ROUNDS, ROOM = 200_000, 3, 32

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long, task_gap long, given_up boolean"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row of PIECE for each piece of each text."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(path, False).encode
        for batch in batches(rows):
            keys, texts = zip(*batch, strict=True)
            ids, sizes = encode([t or "" for t in texts])
            raw, out, at = memoryview(ids.astype("<u4").tobytes()), [], 0
            for key, size in zip(keys, sizes.tolist(), strict=True):
                for k, start in enumerate(range(0, size, capacity)):
                    n = min(capacity, size - start)
                    out.append((key, k, start, n, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + n)])))
                at += size
            columns = zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], [x.split()[0] for x in PIECE.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of the sum and two families of dual feasible functions."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    many, weight = np.cumsum(n), np.cumsum(n * size)
    best = -(-int(weight[-1]) // capacity)
    # below a: nothing; above capacity - a: a whole bin; else the length
    a = np.arange(1, capacity // 2 + 1)
    bins = capacity * (many[-1] - many[capacity - a]) + weight[capacity - a] - weight[a - 1]
    best = max(best, int((-(-bins // capacity)).max()))
    # lengths rounded down to multiples of 1/k, unless they are a multiple of 1/(k + 1)
    for k in range(1, 101):
        whole = (k + 1) * size % capacity == 0
        # in units of capacity * k: size * k, or floor((k + 1) size / capacity) * capacity
        value = np.where(whole, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the room left in each bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fit := some >> n:
            r = n + (fit & -fit).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            r, k = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = k, capacity - r
        room[k] = r = r - n
        if r:
            by_room[r].append(k)
            some |= 1 << r
    return bins, offsets, np.array(room, np.int64)


def _packer(turn: int, last: bool, capacity: int):
    """Packs all pieces of a task. last: nothing is given up."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        got = [b for b in rows if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        # dealt rows come in any order: sort, so that a repeated task packs alike
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        lengths = table["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        gives = (room >= ROOM) & (gap > 0)
        gives[np.argmax(room)] = True
        gives &= (room > 0) & (not last)
        ids = (turn << 56) + (TaskContext.get().partitionId() << 32) + bins
        for name, column in (("sequence_id", ids), ("offset", offsets), ("task_gap", np.full(len(ids), gap)), ("given_up", gives[bins])):
            table = table.append_column(name, pa.array(column))
        yield from table.to_batches(65_536)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PIECE rows with sequence_id and offset. Runs one pass over the lengths for each exchange."""
    rest, done = stage(items, "pieces"), []
    for turn in range(ROUNDS + 1):
        n = rest.count()
        tasks = max(1, -(-n // PER_TASK))
        last = turn == ROUNDS
        dealt = rest.repartition(tasks, F.xxhash64("doc_id", "piece", F.lit(turn)), "ids_crc32") if tasks > 1 else rest.coalesce(1)
        packed = stage(dealt.mapInArrow(_packer(turn, last or (tasks == 1 and turn > 0), capacity), PACKED), "packed")
        done.append(packed.where("not given_up").drop("task_gap", "given_up"))
        rest = packed.where("given_up").select(*items.columns)
        if last or tasks == 1 and turn > 0 or rest.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    return pack(pieces(docs, path))
