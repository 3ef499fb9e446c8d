"""Token counts under a unigram vocabulary, by a Viterbi that carries only a score and a piece count.

The pieces and scores of a public sentencepiece file are read as a unigram vocabulary with byte fallback, in
the sense of tokenizers' ``Unigram`` model behind a ``Metaspace`` pre-tokenizer (a space becomes the mark, one
is put in front, and words are cut before each mark). An Aho-Corasick automaton lists the vocabulary matches of
a word; for each end position the best path keeps its score and how many pieces it has. Paths are never stored.

Tie rule (the library's): matches are seen by ascending start, and only a strictly better score replaces one,
so of equal scores the longest last piece stays. A character that is no piece by itself costs the least score
less ten and counts as its UTF-8 bytes.

Null or empty texts count 0 tokens. Repeated rows give repeated rows. doc_id may be null and is passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batches
from quillspark.llm.token_ids import tokenizer_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words a worker's cache holds before it is emptied.
CACHE = 1_000_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Tokens of a word (its mark included), keyed by the word without its mark, while it stays here."""

    def __init__(self, path: str):
        import ahocorasick

        pieces = vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = self.viterbi(word)
        return n

    def viterbi(self, word: str) -> int:
        word = MARK + word
        n = len(word)
        ending: list = [()] * (n + 1)
        single = bytearray(n)
        for last, match in self.automaton.iter(word):
            ending[last + 1] += (match,)
            if match[0] == 1:
                single[last] = 1
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best, pieces = None, 0
            for length, s in sorted(ending[end], reverse=True):  # longest first: ascending start
                s += score[end - length]
                if best is None or s > best:
                    best, pieces = s, count[end - length] + 1
            if not single[end - 1]:
                s = self.unknown + score[end - 1]
                if best is None or s > best:
                    best, pieces = s, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            score[end], count[end] = best, pieces
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        words = (text if text[0] == " " else f" {text}").split(" ")[1:]
        return sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars (code points), n_tokens of each row of docs (doc_id, text; other columns are left out)."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        tokens = counter(path)
        for batch in batches(rows):
            ids, texts = zip(*batch, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([tokens.count(t) for t in texts], pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
