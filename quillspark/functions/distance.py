"""Edit distances: weighted optimal string alignment, keyboard-aware typing distance, shared n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a distance beyond its limit.
FAR = 1_048_575


@dataclass(frozen=True)
class Weights:
    """Costs of one edit (fixed values)."""

    insert: int = 95
    delete: int = 95
    swap: int = 90
    substitute: int = 100


@dataclass(frozen=True)
class TypoWeights:
    """Costs of a typing error (fixed values)."""

    missing: int = 85
    swap: int = 60
    near: int = 70
    far: int = 110
    extra_near: int = 70
    extra: int = 100


#: Keys next to each other (fixed values): neighbours in the rows of a standard keyboard.
STANDARD_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


@dataclass(frozen=True)
class Keyboard:
    """Pairs of neighbouring keys, and groups of characters that share a key."""

    near: frozenset[tuple[str, str]]
    keys: tuple[str, ...] = ()

    @staticmethod
    def of(pairs: Iterable[tuple[str, str]], keys: Iterable[str] = ()) -> Keyboard:
        pairs = list(pairs)
        return Keyboard(frozenset(pairs + [(b, a) for a, b in pairs]), tuple(keys))

    def normal(self) -> dict[int, str]:
        """Each character of a key as the key's first one."""
        return {ord(c): k[0] for k in self.keys for c in k}


@lru_cache(maxsize=8)
def neighbours(rows: tuple[str, ...] = STANDARD_ROWS) -> frozenset[tuple[str, str]]:
    pairs = [(a, b) for row in rows for a, b in zip(row, row[1:], strict=False)]
    return frozenset(pairs + [(b, a) for a, b in pairs])


def osa(a: str, b: str, w: Weights = Weights()) -> int:
    """Weighted distance with swaps of adjacent characters; equal characters are always matched."""
    while a and b and a[-1] == b[-1]:  # equal ends are always matched
        a, b = a[:-1], b[:-1]
    two, one = None, [w.delete * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [w.insert * i]
        for j, y in enumerate(b, 1):
            if x == y:
                row.append(one[j - 1])
                continue
            best = min(one[j - 1] + w.substitute, one[j] + w.insert, row[j - 1] + w.delete)
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + w.swap)
            row.append(best)
        two, one = one, row
    return one[-1]


def limited_osa(a: str, b: str, limit: int, w: Weights = Weights()) -> int:
    """The distance if it takes at most limit edits at their dearest cost, else FAR. Lengths rule most pairs out."""
    if abs(len(a) - len(b)) > limit:
        return FAR
    d = osa(a, b, w)
    return d if d <= limit * max(w.insert, w.delete, w.swap, w.substitute) else FAR


def typo(candidate: str, typed: str, near: frozenset[tuple[str, str]] = neighbours(), w: TypoWeights = TypoWeights()) -> int:
    """What it costs to mistype candidate as typed."""

    def replaced(x: str, y: str) -> int:
        return 0 if x == y else w.near if (x, y) in near else w.far

    def added(x: str, y: str) -> int:
        return w.extra_near if x == y or (x, y) in near else w.extra

    table = [[w.missing * j for j in range(len(typed) + 1)]]
    for i, x in enumerate(candidate, 1):
        row = [w.extra * i]
        table.append(row)
        for j, y in enumerate(typed, 1):
            if x == y:
                row.append(table[i - 1][j - 1])
                continue
            best = min(table[i - 1][j - 1] + replaced(x, y), row[j - 1] + w.missing)
            if i > 1:
                before = candidate[i - 2]
                best = min(best, table[i - 1][j] + added(before, y), table[i - 2][j - 1] + added(before, y) + replaced(x, y))
                if j > 1:
                    best = min(best, table[i - 2][j - 2] + w.swap + replaced(x, typed[j - 2]) + replaced(before, y))
            else:
                best = min(best, table[i - 1][j] + w.extra)
            row.append(best)
    return table[-1][-1]


#: Pairs of strings that are compared at a time.
CHUNK = 4096
#: Sums of edits below this are kept in two bytes; there it is more than any of them.
BESIDE = 1 << 14


def codes(strings: list[str]) -> np.ndarray:
    """Code points, a row for each place: short strings end in zeros."""
    array = np.array(strings, dtype=np.str_)
    out = array.view(np.uint32).reshape(len(strings), -1).T if len(strings) and array.dtype.itemsize else np.zeros((0, len(strings)), np.uint32)
    return np.ascontiguousarray(out, np.uint16 if out.max(initial=0) < 1 << 16 else np.uint32)


def _many(sizes: np.ndarray, at, table, dearest: int) -> np.ndarray:
    """What table (codes of a, codes of b, first row: a function of i that gives the row of place i) says of each pair, all pairs of like lengths at a time.

    sizes: lengths of a, of b; at: the codes of some pairs. Sums of the dearest edit that fit into two bytes are kept there."""
    out = np.zeros(sizes.shape[1], np.int64)
    by_b = np.argsort(sizes[1], kind="stable")
    for start in range(0, len(by_b), CHUNK):
        own = by_b[start : start + CHUNK]
        own = own[np.argsort(-sizes[0, own], kind="stable")]
        n, m = sizes[:, own]
        most = int(m.max())
        cost = np.int16 if dearest * (int(n[0]) + most + 4) < BESIDE else np.int64
        x, y = at(own)
        step, row = table(x, y[:most], most, cost)
        done = np.flatnonzero(n == 0)
        out[own[done]] = row[m[done], done]
        for i in range(1, int(n[0]) + 1):
            live = int(np.count_nonzero(n >= i))  # longer ones come first
            row = step(i, live)
            done = np.flatnonzero(n[:live] == i)
            out[own[done]] = row[m[done], done]
    return out


def _strings(a: list[str], b: list[str]):
    """Lengths, and the codes of some pairs, of two lists of strings."""
    return np.array([list(map(len, a)), list(map(len, b))], np.int64).reshape(2, -1), lambda own: (codes([a[i] for i in own]), codes([b[i] for i in own]))


def osa_many(a: list[str], b: list[str], w: Weights = Weights()) -> np.ndarray:
    """osa() of each pair."""
    return osa_coded(*_strings(a, b), w)


def osa_coded(sizes: np.ndarray, at, w: Weights = Weights()) -> np.ndarray:
    """osa() of each pair: sizes has their lengths, at(numbers of pairs) gives the codes of both sides."""

    def table(x, y, m, cost):
        beside = BESIDE if cost is np.int16 else FAR * FAR
        rows = [None, np.repeat((w.delete * np.arange(m + 1, dtype=cost))[:, None], x.shape[1], 1)]
        equal = [None]

        def step(i, k):
            two, one = rows
            one = one[:, :k]
            same = (x[i - 1, :k] == y[:, :k]).astype(cost)
            best = np.minimum(one[:-1] + (1 - same) * w.substitute, one[1:] + w.insert)
            if i > 1 and m > 1:
                swapped = same[:-1] & equal[0][1:, :k]
                np.minimum(best[1:], two[:-2, :k] + (1 - swapped) * beside + w.swap, out=best[1:])
            new = _row(best, same, one, w.insert * i, w.delete)
            rows[:], equal[0] = (one, new), same
            return new

        return step, rows[1]

    return _many(sizes, at, table, max(w.insert, w.delete, w.swap, w.substitute))


def _row(best: np.ndarray, same: np.ndarray, one: np.ndarray, first: int, left: int) -> np.ndarray:
    """The next row: the best, or the left neighbour's and left. Equal letters keep what stood before both: best holds no more there."""
    new, least = np.empty_like(one), one[:-1] * same
    new[0] = first
    for j in range(1, len(new)):
        row = new[j]
        np.add(new[j - 1], left, out=row)
        np.minimum(row, best[j - 1], out=row)
        np.maximum(row, least[j - 1], out=row)
    return new


def typo_many(candidates: list[str], typed: list[str], near: frozenset[tuple[str, str]] = neighbours(), w: TypoWeights = TypoWeights()) -> np.ndarray:
    """typo() of each pair."""
    return typo_coded(*_strings(candidates, typed), near, w)


@lru_cache(maxsize=8)
def _keys(near: frozenset[tuple[str, str]]):
    """Which keys (by number) are near each other; for up to 64 keys a bit for each, and of each the bits of those near it; the number of each code's key."""
    letters = np.array(sorted({ord(c) for pair in near for c in pair}), np.uint32)
    close = np.zeros((len(letters) + 1, len(letters) + 1), bool)
    key = {int(c): i for i, c in enumerate(letters)}
    for p, q in near:
        close[key[ord(p)], key[ord(q)]] = True
    bits = np.uint32 if len(letters) <= 32 else np.uint64
    own = np.append(np.left_shift(bits(1), np.arange(len(letters), dtype=bits)), bits(0)) if len(letters) <= 64 else None
    beside = None if own is None else (close * own).sum(axis=1, dtype=bits)

    def search(points):
        """Of each character its number among the keys; others have the last one, which is near nothing."""
        i = np.searchsorted(letters, points)
        return np.where(np.isin(points, letters), i, len(letters)) if len(letters) else np.zeros(points.shape, np.int64)

    short = search(np.arange(1 << 16, dtype=np.uint32))
    return close, own, beside, lambda points: short[points] if points.dtype == np.uint16 else search(points)


def typo_coded(sizes: np.ndarray, at, near: frozenset[tuple[str, str]] = neighbours(), w: TypoWeights = TypoWeights()) -> np.ndarray:
    """typo() of each pair: sizes has their lengths, at(numbers of pairs) gives the codes of both sides."""
    close, own, beside, place = _keys(near)

    def table(x, y, m, cost):
        rows = [None, np.repeat((w.missing * np.arange(m + 1, dtype=cost))[:, None], x.shape[1], 1)]
        px, py = place(x), place(y)
        if own is not None:
            px, py = beside[px], own[py]
        before = [None, None]

        def step(i, k):
            two, one = rows
            one = one[:, :k]
            same = x[i - 1, :k] == y[:, :k]
            by = (px[i - 1, :k] & py[:, :k]) != 0 if own is not None else close[px[i - 1, :k], py[:, :k]]
            also, same = (same | by).astype(cost), same.astype(cost)
            replaced = (1 - same) * (w.far - also * (w.far - w.near))
            best = one[:-1] + replaced
            if i == 1:
                np.minimum(best, one[1:] + w.extra, out=best)
            else:
                added, second = (z[:, :k] for z in before)
                two = two[:, :k]
                np.minimum(best, np.minimum(one[1:], two[:-1] + replaced) + added, out=best)
                if m > 1:
                    best[1:] = np.minimum(best[1:], two[:-2] + w.swap + replaced[:-1] + second[1:])
            new = _row(best, same, one, w.extra * i, w.missing)
            rows[:] = one, new
            before[:] = w.extra - also * (w.extra - w.extra_near), replaced
            return new

        return step, rows[1]

    return _many(sizes, at, table, 2 * max(w.missing, w.swap, w.near, w.far, w.extra_near, w.extra))


def _pairwise(f):
    """An Arrow function of two string columns; f takes lists of strings. Nulls stay null."""
    @F.pandas_udf(T.IntegerType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            both = (a.notna() & b.notna()).to_numpy()
            out = pd.Series([pd.NA] * len(a), dtype="Int32")
            if both.any():
                out[both] = f(a[both].tolist(), b[both].tolist())
            yield out

    return run


def osa_distance(a: str | Column, b: str | Column, weights: Weights = Weights()) -> Column:
    return _pairwise(lambda x, y: osa_many(x, y, weights))(a, b)


def typo_distance(candidate: str | Column, typed: str | Column, keyboard: Keyboard | tuple[str, ...] = STANDARD_ROWS) -> Column:
    """keyboard: rows of keys, or pairs and keys as read from a definition."""
    board = keyboard if isinstance(keyboard, Keyboard) else Keyboard(neighbours(keyboard))
    normal = board.normal()

    def run(x: list[str], y: list[str]) -> np.ndarray:
        if normal:
            x, y = ([s.translate(normal) for s in z] for z in (x, y))
        return typo_many(x, y, board.near)

    return _pairwise(run)(candidate, typed)


def osa_expression(a: Column, b: Column, w: Weights = Weights()) -> Column:
    """The weighted distance as nested folds: all in the JVM, for short strings and comparison."""
    one = F.transform(F.sequence(F.lit(0), F.length(b)), lambda j: (j * w.delete).cast("int"))
    start = F.struct(F.array().cast("array<int>").alias("two"), one.alias("one"))

    def row(state: Column, i: Column) -> Column:
        x, px = F.substring(a, i, F.lit(1)), F.substring(a, i - 1, F.lit(1))

        def cell(done: Column, j: Column) -> Column:
            y, py = F.substring(b, j, F.lit(1)), F.substring(b, j - 1, F.lit(1))
            diagonal = F.get(state["one"], j - 1)
            plain = F.least(diagonal + w.substitute, F.get(state["one"], j) + w.insert, F.get(done, j - 1) + w.delete)
            swapped = F.when((i > 1) & (j > 1) & (x == py) & (px == y), F.get(state["two"], j - 2) + w.swap)
            return F.concat(done, F.array(F.when(x == y, diagonal).otherwise(F.least(plain, F.coalesce(swapped, plain)))))

        new = F.aggregate(F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b))).otherwise(F.array().cast("array<int>")), F.array((i * w.insert).cast("int")), cell)
        return F.struct(state["one"].alias("two"), new.alias("one"))

    steps = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, row, lambda s: F.element_at(s["one"], -1))


def _found_in(a: Column, b: Column, j: int):
    return lambda i: F.contains(b, F.substring(a, i, F.lit(j)))


def ngram_score(n: int, a: Column, b: Column) -> Column:
    """Parts of a of up to n characters that b contains, level by level while a level has two; less for a longer b."""
    total, going = F.lit(0), F.lit(True)
    for j in range(1, n + 1):
        starts = F.when(F.length(a) >= j, F.sequence(F.lit(1), F.length(a) - (j - 1))).otherwise(F.array().cast("array<int>"))
        level = F.size(F.filter(starts, _found_in(a, b, j)))
        total = total + F.when(going, level).otherwise(0)
        going = going & (level >= 2)
    return total - F.greatest(F.lit(0), F.length(b) - F.length(a) - 2)
