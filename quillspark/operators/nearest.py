"""Searches that look at many pairs and keep few: kernels over arrays, run as Arrow functions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.distance import Weights, codes, neighbours, osa_coded, typo_coded

#: Soundslikes that are searched for at a time, and in a block of those that are looked at.
CHUNK, BLOCK = 1024, 131_072
#: Parts that this share of a block holds, or more, are kept as a row of it; others as a list of places.
DENSE = 1 / 32


def _parts(s: str, n: int) -> list[str]:
    return [s[i : i + size] for size in range(1, n + 1) for i in range(len(s) - size + 1)]


class Parts:
    """Which strings of a block hold a part of up to n characters."""

    def __init__(self, strings: list[str], n: int):
        self.n = n
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        where: dict[str, list[int]] = {}
        for i, s in enumerate(strings):
            for part in set(_parts(s, n)):
                where.setdefault(part, []).append(i)
        self.rows, self.places = {}, {}
        for part, at in where.items():
            places = np.array(at, np.int64)
            if len(at) >= DENSE * len(strings):
                row = self.rows[part] = np.zeros(len(strings), np.int8)
                row[places] = 1
            else:
                self.places[part] = places
        self.longer: dict[int, np.ndarray] = {}

    def best(self, a: str, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores, as ngram_score() gives them, of all that tie with one of the keep best above 0.

        A shared part means that its own parts are shared: the levels of the score need no gates."""
        wide = self.n * len(a) > 120 or len(self.sizes) and self.sizes.max() > 120
        score = np.zeros(len(self.sizes), np.int32 if wide else np.int8)
        for part in _parts(a, self.n):
            row = self.rows.get(part)
            if row is not None:
                score += row
            elif (places := self.places.get(part)) is not None:
                score[places] += 1
        if len(a) not in self.longer:
            self.longer[len(a)] = np.maximum(0, self.sizes - len(a) - 2)
        score -= self.longer[len(a)].astype(score.dtype)
        least = int(score.max(initial=0))
        while least > 1 and np.count_nonzero(score >= least) < keep:
            least -= 1
        at = np.flatnonzero(score >= max(1, least))
        return at, score[at]


def best_by_parts(left: DataFrame, right: DataFrame, n: int, keep: int, most: int = BLOCK) -> DataFrame:
    """a, b, ngram: of each distinct a of left those of right's distinct b that tie with one of the keep best.

    All pairs are scored: an a takes one addition over a block for each of its parts."""
    left, right = left.select("a").distinct(), right.select("b").distinct()
    chunks, blocks = (max(1, -(-side.count() // size)) for side, size in ((left, CHUNK), (right, most)))

    def packed(side: DataFrame, name: str, number: str, count: int) -> DataFrame:
        return side.groupBy(F.pmod(F.xxhash64(name), F.lit(count)).alias(number)).agg(F.collect_list(name).alias(name))

    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = packed(left, "a", "chunk", chunks).repartition(min(chunks, width)).crossJoin(packed(right, "b", "block", blocks)).select("a", "block", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, strings = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(1)[i].as_py()
                if number != block:
                    values = batch.column(2)[i].values
                    block, strings = number, values
                    index = Parts(values.to_pylist(), n)
                wanted = batch.column(0)[i].as_py()
                found = [index.best(a, keep) for a in wanted]
                sizes = [len(at) for at, _ in found]
                at = np.concatenate([x for x, _ in found])
                a = pa.array(wanted, pa.string()).take(pa.array(np.repeat(np.arange(len(wanted)), sizes)))
                yield pa.RecordBatch.from_arrays([a, strings.take(pa.array(at)).cast(pa.string()), pa.array(np.concatenate([x for _, x in found]).astype(np.int32))], names=["a", "b", "ngram"])

    found = pairs.mapInArrow(run, "a string, b string, ngram int")
    if blocks == 1:
        return found
    rank = F.rank().over(Window.partitionBy("a").orderBy(F.desc("ngram")))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")


def unit_osa(x: np.ndarray, sizes: np.ndarray, masks: np.ndarray, y: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Insertions, deletions, substitutions and swaps of neighbours between pairs of strings, each of weight one.

    x: of each pair the row of masks (one bit for each place of a letter, a column for each letter) and sizes; y: the
    column of codes and the place in lengths. All places of an x are worked off at once, as bits of a number."""
    order = np.argsort(-lengths[y].astype(np.int16), kind="stable")  # longer ones come first
    x, y = x[order], y[order]
    n, m = sizes[x], lengths[y].astype(np.int64)
    table, start, one = masks.ravel(), x.astype(np.int64) * masks.shape[1], masks.dtype.type(1)
    top = (np.maximum(n, 1) - 1).astype(masks.dtype)
    vp, vn, d0, before = (np.full(len(x), v, masks.dtype) for v in (np.iinfo(masks.dtype).max, 0, 0, 0))
    out = n.astype(masks.dtype)
    for j, k in enumerate(np.searchsorted(-m, -np.arange(1, int(m.max(initial=0)) + 1), side="right")):
        at = table.take(start[:k] + codes[j].take(y[:k]))
        p, q = vp[:k], vn[:k]
        d = (((at & p) + p) ^ p) | at | q | (((~d0[:k] & at) << one) & before[:k])
        up, down = q | ~(d | p), d & p
        out[:k] += (up >> top[:k]) & one
        out[:k] -= (down >> top[:k]) & one
        up = (up << one) | one
        vp[:k], vn[:k], d0[:k], before[:k] = (down << one) | ~(d | up), up & d, d, at
    back = np.empty(len(x), np.int32)
    back[order] = np.where(n == 0, m, out.astype(np.int64))
    return back


#: Pairs whose distance is computed at a time: their arrays stay in a core's cache.
SLICE = 12_288
#: Soundslikes that are searched for at a time.
SOUNDS = 512


class Entries:
    """Strings y of a block, by their soundslike b."""

    def __init__(self, groups: list[dict]):
        self.strings = [y["y"] for g in groups for y in g["ys"]]
        self.plain = np.array([y["plain"] and y["y"].isascii() for g in groups for y in g["ys"]], bool)
        ends = np.cumsum([len(g["ys"]) for g in groups])
        self.counts = np.array([len(g["ys"]) for g in groups], np.int64)
        self.firsts = ends - self.counts
        sounds = [g["b"] for g in groups]
        self.sounds, self.sound_codes = pa.array(sounds, pa.string()), codes(sounds)
        self.sound_lengths = np.fromiter(map(len, sounds), np.int64, len(sounds))
        self.lengths = np.fromiter(map(len, self.strings), np.int64, len(self.strings))
        points = np.fromiter((ord(c) for y in self.strings for c in y), np.int64)
        self.letters = np.unique(points)
        self.codes = np.zeros((int(self.lengths.max(initial=0)), len(self.strings)), np.uint16)  # 0: behind the end
        column = np.repeat(np.arange(len(self.strings)), self.lengths)
        row = np.arange(len(points)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.codes[row, column] = np.searchsorted(self.letters, points) + 1
        self.points = np.append(0, self.letters).astype(np.uint16 if self.letters.max(initial=0) < 1 << 16 else np.uint32)
        self.codes_of = {chr(c): i + 1 for i, c in enumerate(self.letters)}

    def code_points(self, at: np.ndarray) -> np.ndarray:
        size = int(self.lengths[at].max(initial=0))
        return self.points.take(self.codes[:size].take(at, axis=1))

    def masks(self, xs: list[str]) -> np.ndarray:
        size = max(map(len, xs), default=0)
        out = np.zeros((len(xs), len(self.letters) + 1), np.uint32 if size <= 32 else np.uint64)
        one = out.dtype.type(1)
        for i, x in enumerate(xs):
            for j, c in enumerate(x[:64]):
                if c in self.codes_of:
                    out[i, self.codes_of[c]] |= one << out.dtype.type(j)
        return out


@dataclass(frozen=True)
class Rule:
    """How the scores of words and soundslikes are weighed, and how far above the threshold a score may lie: that is span
    above the third least of different keys (skip + 1), and 100 at least."""

    word_weight: int
    sound_weight: int
    span: int
    skip: int
    limit: int | None = None  # only so many of the best are wanted
    keyboard: tuple[str, ...] | None = None
    typed: bool = False  # ranked by typing distances

    def adjusted(self, word, sound):
        s = self.sound_weight
        return (self.word_weight * word + np.where(word < 100, -(-s // 8), np.where(word <= 110, -(-s // 2), s)) * sound) // 100

    def wanted(self, score: np.ndarray, adj: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Which of a word's near ones can be among the best, whatever the threshold, or tell how hard the word is.

        Who has limit others of a lower adj and no higher score is never listed; the first ones and the last one by score stay."""
        if self.limit is None or len(score) <= self.limit or adj is not score and len(score) > 4096:
            return np.ones(len(score), bool)
        if adj is score:  # one order
            beaten = np.searchsorted(np.sort(score[plain]), score)
        else:
            beaten = ((score[None] <= score[:, None]) & (adj[None] < adj[:, None]) & plain[None]).sum(axis=1)
        keep = (beaten < self.limit) | ~plain
        keep[np.argpartition(score, min(self.skip + 3, len(score) - 1))[: self.skip + 3]] = True
        keep[np.argmax(score)] = True
        return keep

    def weighted(self, word, sound):
        return (self.word_weight * word + self.sound_weight * sound) // 100

    def most(self, scores: np.ndarray) -> int:
        third = int(np.partition(scores, self.skip)[self.skip]) if len(scores) > self.skip else int(scores.max(initial=0))
        return max(100, third + self.span) + self.span


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as counts has."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _near(index: Entries, words: pa.StructArray, pairs: pa.StructArray, rule: Rule):
    """x, y (or -1: others of x are too far), word, sound of a chunk's words (a, x, plain) and pairs (a, bs) of soundslikes: what can matter.

    n edits of weight one weigh 90 n to 100 n: what lies above the bound of the third least is no more looked at, nor, where
    the score itself ranks, what so many others as are wanted are sure to beat."""
    xs, plain, names = words.field("x").to_pylist(), words.field("plain").to_numpy(zero_copy_only=False), words.field("a").unique()
    sound_of = pc.index_in(words.field("a"), names).to_numpy()
    lists = pairs.field("bs")
    a, b = (pc.fill_null(pc.index_in(side, of), -1).to_numpy() for side, of in ((pairs.field("a"), names), (lists.flatten(), index.sounds)))
    a = np.repeat(a, pc.list_value_length(lists).to_numpy())
    at = np.flatnonzero((a >= 0) & (b >= 0))
    at = at[np.argsort(a[at], kind="stable")]
    a, b = a[at], b[at]
    said = codes(names.to_pylist())
    told = osa_coded(np.stack([pc.utf8_length(names).to_numpy()[a], index.sound_lengths[b]]).astype(np.int64), lambda i: (said.take(a[i], axis=1), index.sound_codes.take(b[i], axis=1))).astype(np.int32)
    held = index.counts[b]
    begin = np.searchsorted(a, np.arange(len(names) + 1))
    total = np.diff(np.append(0, np.cumsum(held))[begin])[sound_of]
    masks, sizes = index.masks(xs), np.fromiter(map(len, xs), np.int64, len(xs))
    typed_as = codes(xs)

    def weigh(f, of: np.ndarray, to: np.ndarray, *more, back: bool = False) -> np.ndarray:
        """f of the strings of and to, or to and of."""
        own, other = (sizes[of], lambda i: typed_as[: int(sizes[of[i]].max(initial=0))].take(of[i], axis=1)), (index.lengths[to], lambda i: index.code_points(to[i]))
        (n, a), (m, b) = (other, own) if back else (own, other)
        return f(np.stack([n, m]), lambda i: (a(i), b(i)), *more)

    kept: list[tuple[np.ndarray, ...]] = []
    dropped = np.zeros(len(xs), bool)
    for first, last in _runs(total.tolist(), SLICE * 16):
        own = sound_of[first:last]
        each = begin[own + 1] - begin[own]
        row = _ranges(begin[own], each)
        counts = held[row]
        who, whom, sounds = np.repeat(np.repeat(np.arange(first, last), each), counts), _ranges(index.firsts[b[row]], counts), np.repeat(told[row], counts)
        edits = np.concatenate([unit_osa(who[i : i + SLICE], sizes, masks, whom[i : i + SLICE], index.lengths, index.codes) for i in range(0, len(who), SLICE)]) if len(who) else np.zeros(0, np.int32)
        long = np.flatnonzero(sizes[who] > 64) if sizes.max() > 64 else ()
        if len(long):
            edits[long] = weigh(osa_coded, who[long], whom[long], Weights(1, 1, 1, 1))
        low, high = rule.weighted(90 * edits, sounds), rule.weighted(100 * edits, sounds)
        ends = np.cumsum(total[first:last]).tolist()
        starts = [0, *ends[:-1]]
        most = np.array([rule.most(high[i:j]) for i, j in zip(starts, ends, strict=True)], np.int32)
        beyond = low > np.repeat(most, total[first:last])
        dropped[who[beyond]] = True
        if rule.limit is not None and not rule.typed:
            # a word with others that are too far needs no more than its best: no matter how far the rest is
            simple, wanted = index.plain[whom] & plain[who], max(rule.limit, rule.skip + 3)
            for i, j, far in zip(starts, ends, dropped[first:last].tolist(), strict=True):
                if far and j - i > wanted and len(sure := high[i:j][simple[i:j]]) > wanted:
                    beyond[i:j] |= simple[i:j] & (low[i:j] > np.partition(sure, wanted - 1)[wanted - 1])
        at = np.flatnonzero(~beyond)
        who, whom, sounds = who[at], whom[at], sounds[at]
        word = weigh(osa_coded, who, whom)
        score = rule.weighted(word, sounds)
        bounds = np.searchsorted(who, np.arange(first, last + 1))
        limit = np.repeat([rule.most(score[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)], np.diff(bounds))
        near = score <= limit
        dropped[who[~near]] = True
        who, whom, word, sounds, score = who[near], whom[near], word[near], sounds[near], score[near]
        if rule.limit is not None and len(who):
            adj, simple = score, index.plain[whom] & plain[who]
            if rule.typed:
                typed = weigh(typo_coded, who, whom, neighbours(rule.keyboard), back=True) if rule.keyboard else word
                adj = rule.adjusted(typed, sounds)
            bounds = np.searchsorted(who, np.arange(first, last + 1))
            own = [(score[i:j], adj[i:j], simple[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]
            keep = np.concatenate([rule.wanted(x, y if rule.typed else x, z) for x, y, z in own])
            who, whom, word, sounds = who[keep], whom[keep], word[keep], sounds[keep]
        kept.append((who, whom, word, sounds))
    none = np.flatnonzero(dropped)
    kept.append((none, np.full(len(none), -1), np.zeros(len(none), np.int64), np.zeros(len(none), np.int64)))
    return xs, *map(np.concatenate, zip(*kept, strict=True))


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) of neighbours that have most together, or are one."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if sizes:
        yield first, len(sizes)


#: The block that a worker process used last, for its next task: its name, its entries and their strings.
_held: list = [None, None, None]


def _block(name: tuple[str, int], held: pa.Scalar) -> tuple[Entries, pa.Array]:
    if _held[0] != name:
        _held[:] = None, None, None
        index = Entries(held.as_py())
        _held[:] = name, index, pa.array(index.strings, pa.string())
    return _held[1], _held[2]


def near_words(words: DataFrame, pairs: DataFrame, entries: DataFrame, rule: Rule, most: int = BLOCK) -> DataFrame:
    """x, y, word, sound: of words (a, x) and entries (b, y) whose soundslikes are pairs (a, b), or (a, bs) with an array, those that may come under their x's bound, with weighted distances. A row without y: others of x are beyond it.

    All entries of the pairs are looked at, by their unweighted distance first. plain: the string is what typing distances compare."""
    words, entries = (side if "plain" in side.columns else side.withColumn("plain", F.lit(False)) for side in (words, entries))
    words, entries = words.groupBy("a", "x").agg(F.bool_and("plain").alias("plain")), entries.groupBy("b", "y").agg(F.bool_and("plain").alias("plain"))
    if "bs" not in pairs.columns:
        pairs = pairs.groupBy("a").agg(F.collect_list("b").alias("bs"))
    sounds = entries.groupBy("b").agg(F.collect_list(F.struct("y", "plain")).alias("ys"))
    chunks = max(1, -(-words.select("a").distinct().count() // SOUNDS))
    blocks = max(1, -(-entries.select("y").distinct().count() // most))
    width = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(side: DataFrame, name: str, *columns: str) -> DataFrame:
        rows = side.select(F.pmod(F.xxhash64("a"), F.lit(chunks)).alias("chunk"), F.struct(*columns).alias(name))
        return rows.repartition(min(chunks, 4 * width), "chunk").groupBy("chunk").agg(F.collect_list(name).alias(name))

    held = sounds.groupBy(F.pmod(F.xxhash64("b"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("b", "ys")).alias("held"))
    both = dealt(words, "words", "a", "x", "plain").join(dealt(pairs, "pairs", "a", "bs"), "chunk").crossJoin(held).select("words", "pairs", "block", "held")

    search = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                index, strings = _block((search, batch.column(2)[i].as_py()), batch.column(3)[i])
                xs, who, whom, word, sound = _near(index, batch.column(0)[i].values, batch.column(1)[i].values, rule)
                y = strings.take(pa.array(whom, mask=whom < 0))
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.string()).take(pa.array(who)), y, pa.array(word.astype(np.int32)), pa.array(sound.astype(np.int32))], names=["x", "y", "word", "sound"])

    return both.mapInArrow(run, "x string, y string, word int, sound int")
