"""Quality scores by compression: one zstandard dictionary from good labelled text, one from bad.

A text is compressed in pieces of PIECE bytes with either dictionary. What decides is one number: the difference of
the two compressed sizes, normalised by the text's bytes. A logistic curve of that number, which only rises, turns it
into a probability of label 1.

Training takes labelled rows that are not held out (crc32 of the id's text, mod 5, is not 0): in the order of a hash,
at most FIT_ROWS of each label and of these at most FIT_TOTAL characters, texts of up to FIT_CHARS characters; one half
makes the dictionaries, the other fits the curve. There each label weighs as much as all labelled rows of docs that are
not held out give it, so the share of label 1 does not depend on the bound. Scoring covers whole texts of all rows. An
id with several labels counts with the lowest, one with several texts with the least.

Null and empty texts are scored like a text without characters. Without labels of both kinds every score is the
share of label 1 (0.5 without labels). Repeated rows give repeated rows, ties in size score alike; null doc_ids are
not held out. An empty table gives an empty one. Other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import batches

FIT_ROWS, FIT_CHARS, FIT_TOTAL = 3000, 100_000, 12 << 20
PIECE, LEVEL, DICT_BYTES = 1024, 3, 32 << 10
FOLDS, THRESHOLD = 5, 0.3
RIDGE = 1e-3


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def dictionary(texts: list[bytes]) -> bytes:
    """Content of a trained dictionary; for too few samples, the samples' last bytes."""
    import zstandard

    samples = [t[i : i + 2 * PIECE] for t in texts for i in range(0, len(t), 2 * PIECE)]
    size = min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"\n" * 8


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float | None = None
    shift: float = 0.0
    share: float = 0.5

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def compressors(self):
        import zstandard

        if "_compressors" not in self.__dict__:
            own = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            dicts = [zstandard.ZstdCompressionDict(d) for d in (self.good, self.bad)]
            for d in dicts:
                d.precompute_compress(LEVEL)
            self._compressors = [zstandard.ZstdCompressor(dict_data=d, **own).compress for d in dicts]
        return self._compressors

    def difference(self, text: str | None) -> float:
        """Bytes that the good dictionary saves over the bad one, for each byte of text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        good, bad = self.compressors()
        saved = 0
        for i in range(0, len(raw), PIECE):
            piece = raw[i : i + PIECE]
            saved += len(bad(piece)) - len(good(piece))
        return saved / max(1, len(raw))

    def fit(self, texts: list[str], labels: list[int]) -> None:
        """Rows of label 1 weigh share of all, those of label 0 the rest. If good texts don't save more, the share is all that is known."""
        x, y = np.array([self.difference(t) for t in texts]), np.array(labels, float)
        of = np.where(y == 1, self.share / y.mean(), (1 - self.share) / (1 - y.mean()))
        mean = np.average(x, 0, of)
        scale = np.sqrt(np.average((x - mean) ** 2, 0, of)) + 1e-9
        x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        w, ridge = np.zeros(2), np.array([1e-9, RIDGE]) * len(y)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (of * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (of * (y - p)) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        if w[1] > 0:
            self.slope, self.shift = float(w[1] / scale), float(w[0] - w[1] * mean / scale)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.slope is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.shift + self.slope * np.array([self.difference(t) for t in texts]), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out, weighted by the labels of all of them."""
    known = labels.select(F.col("doc_id").cast("long"), "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    every = {r["quality"]: r["count"] for r in known.join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi").groupBy("quality").count().collect()}
    mixed = F.xxhash64("doc_id", F.lit("fit"))
    parts = [known.where(F.col("quality") == q).orderBy(mixed, "doc_id").limit(rows) for q in (0, 1)]
    # at most 2 * rows ids: small by construction
    few = docs.select(F.col("doc_id").cast("long"), "text").where(F.length("text") <= FIT_CHARS).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    few = few.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("quality").orderBy(mixed, "doc_id"))
    few = few.withColumn("upto", upto).where(F.col("upto") <= FIT_TOTAL).drop("upto")
    got = sorted(((zlib.crc32(b"fit" + str(r["doc_id"]).encode()), r["doc_id"], r["text"], r["quality"]) for r in few.limit(2 * rows).collect()), key=lambda x: x[:2])
    by = {q: [(t, q) for _, _, t, own in got if own == q] for q in (0, 1)}
    made = {q: dictionary([t.encode("utf-8", "surrogatepass") for t, _ in by[q][::2]]) for q in (0, 1)}
    model = Model(made[1], made[0], share=every.get(1, 0) / sum(every.values()) if every else 0.5)
    rest = [x for q in (0, 1) for x in (by[q][1::2] or by[q])]
    if by[0] and by[1]:
        model.fit(*map(list, zip(*rest, strict=True)))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text), learnt from labels (doc_id, quality)."""
    model = train(docs, labels)

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches(rows):
            ids, texts = zip(*batch, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.scores(list(texts)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
