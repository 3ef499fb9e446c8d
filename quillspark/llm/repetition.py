"""Quality rules on repetition, from the suffix array of each text's words.

The suffixes of a text's word sequence are ranked by prefix doubling; neighbours in that order share their
longest common prefix. An interval of that array whose prefixes are at least MIN_MATCH words long is a maximal
repeated substring; the union of all its occurrences is the repeated part. A text is rejected if that part is
more than MAX_COVERED of its words, or if one repeat is longer than MAX_REPEAT words.

Every occurrence counts, the first included. Texts without words (null, empty, blank) have all counts 0 and
fail the base rule. Repeated rows give repeated rows; doc_id may be null. Lines end at \\n only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import batches, field, quoted, slices

#: Words a repeat has at least; share of covered words and length of one repeat that are still kept.
MIN_MATCH, MAX_COVERED, MAX_REPEAT = 10, 0.2, 200
#: Base rule: words at least, window of the repeat count, its share at most.
MIN_WORDS, WINDOW, MAX_WINDOW_SHARE = 20, 8, 0.3
SYMBOLS = "[#*$%&|<>]"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"
_SYMBOLS = re.compile(SYMBOLS)


def dense_ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(key, kind="stable")
    new = np.empty(len(key), np.int64)
    sorted_key = key[order]
    step = np.zeros(len(key), np.int64)
    step[1:] = sorted_key[1:] != sorted_key[:-1]
    new[order] = np.cumsum(step)
    return new, int(new.max()) + 1 if len(key) else 0


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Order of all suffixes. rank: dense ranks of the tokens; each text must end in a token found once.

    Only suffixes that still share their rank are sorted again, by the rank k words on."""
    n, k = len(rank), 1
    order = np.argsort(rank, kind="stable")
    rank = _heads(rank[order] != np.roll(rank[order], 1), order)
    while True:
        by = rank[order]
        tied = np.zeros(n, bool)
        same = by[1:] == by[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        own = order[at]
        second = rank[np.minimum(own + k, n - 1)]
        head = rank[own]
        move = np.lexsort((second, head))
        own, second, head = own[move], second[move], head[move]
        order[at] = own
        first = np.ones(len(at), bool)
        first[1:] = (head[1:] != head[:-1]) | (second[1:] != second[:-1])
        fresh = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        rank[own] = fresh
        k *= 2


def _heads(first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of each suffix: the position in order at which its class begins."""
    first = first.copy()
    first[:1] = True
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return rank


def common_prefixes(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[i]: words that the suffixes order[i - 1] and order[i] share. Compared level by level, longest runs last."""
    n = len(tokens)
    lcp = np.zeros(n, np.int64)
    live = np.arange(1, n)
    a, b = order[:-1].copy(), order[1:].copy()
    while len(live):
        same = tokens[a] == tokens[b]
        live, a, b = live[same], a[same] + 1, b[same] + 1
        lcp[live] += 1
        if len(live) < 4096 or lcp[live[0]] > 64:
            break
    if len(live):  # the few long ones: by Kasai's bound along the text
        lcp = _kasai(tokens, order, lcp, live)
    return lcp


def _kasai(tokens: np.ndarray, order: np.ndarray, lcp: np.ndarray, live: np.ndarray) -> np.ndarray:
    n = len(tokens)
    todo = np.zeros(n, bool)
    todo[live] = True
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    t, before = tokens.tolist(), order.tolist()
    h = 0
    last = -2
    for i in np.flatnonzero(todo[at]).tolist():
        k = int(at[i])
        h = max(int(lcp[k]), h - 1 if last == i - 1 else 0)
        j = before[k - 1]
        while t[i + h] == t[j + h]:
            h += 1
        lcp[k] = h
        last = i
    return lcp


def covered(length_at: np.ndarray) -> np.ndarray:
    """Positions that lie in one of the spans [i, i + length_at[i])."""
    i = np.arange(len(length_at))
    return np.maximum.accumulate(i + length_at) > i


def repetition(texts: list[str]) -> list[tuple[int, int, int]]:
    """(words in repeated 8-word windows, words in repeats of MIN_MATCH or more, longest repeat) of each text."""
    seen: dict[bytes, int] = {}
    tokens, sizes = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        sizes.append(len(words))
        tokens += [seen.setdefault(w, len(seen)) for w in words]
        tokens.append(-len(sizes))
    t = np.array(tokens, np.int64)
    t[t < 0] = len(seen) - 1 - t[t < 0]  # each text's end is a token of its own: no repeat crosses texts
    docs = np.repeat(np.arange(len(texts)), np.array(sizes) + 1)
    # texts share no suffix class: the text is the first sort key
    first, _ = dense_ranks(docs * (int(t.max()) + 1) + t)
    order = suffix_array(first)
    lcp = common_prefixes(first, order)
    longest = np.zeros(len(t), np.int64)  # of each suffix, with either neighbour
    longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    ends = np.cumsum(np.array(sizes) + 1)
    starts = ends - np.array(sizes) - 1
    window = np.add.reduceat(covered(np.where(longest >= WINDOW, WINDOW, 0)), starts)
    repeats = np.add.reduceat(covered(np.where(longest >= MIN_MATCH, longest, 0)), starts)
    return list(zip(window.tolist(), repeats.tolist(), np.maximum.reduceat(longest, starts).tolist(), strict=True))


def describe(texts: list[str | None]) -> list[tuple]:
    texts = [t or "" for t in texts]
    out = []
    for text, (window, repeats, longest) in zip(texts, repetition(texts), strict=True):
        words = text.encode("utf-8", "surrogatepass").split()
        n = len(words)
        chars = len(text.translate(_DROP))
        lines = [x for x in text.split("\n") if x.strip(_SPACE)]
        failed = n < MIN_WORDS or 100 * window > round(100 * MAX_WINDOW_SHARE) * n
        kept = not failed and 100 * repeats <= round(100 * MAX_COVERED) * n and longest <= MAX_REPEAT
        out.append((n, chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), window, failed, repeats, longest, kept))
    return out


_SPACE = " \t\n\r\x0b\x0c"
_DROP = dict.fromkeys(map(ord, _SPACE))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text; other columns are left out)."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64()] * 6 + [pa.bool_()] + [pa.int64()] * 2 + [pa.bool_()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches(rows):
            ids, texts = zip(*batch, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip([ids, *zip(*describe(texts), strict=True)], types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def keep_by_rules(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, all columns, whatever their names, as they are."""
    packed = docs.select("text", F.struct(*map(quoted, docs.columns)).alias("doc"))

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in rows:
            for part in slices(batch):
                kept = pa.array([x[-1] for x in describe(part.column(0).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(1).filter(kept)], ["doc"])

    return packed.mapInArrow(run, T.StructType([packed.schema["doc"]])).select(*[field("doc", c) for c in docs.columns])
