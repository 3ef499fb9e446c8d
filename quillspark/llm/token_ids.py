"""Token ids of whole texts by a public tokenizer file, with a bounded cache of chunks.

The tokenizers library cuts texts into words before it merges, and never merges over a white-space character; so a
text's ids are those of its chunks, one after the other. A chunk is cached under a key; a new key is

- a Latin word (letters only): given to the library's own merge model, many words in one call;
- such a word with punctuation behind it: put together from both parts, which the library's pattern cuts there, too;
- anything else: encoded by the whole tokenizer.

Texts in which white space meets white space, or with white space other than spaces and line ends, are encoded
whole where the vocabulary keeps spaces. So are, with either vocabulary, texts that hold an added token's content,
and with the other one texts that hold a character that only Python takes for white space.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import repeat

import numpy as np

#: Chunks a worker's cache holds before it is emptied (about 150 bytes each): in lower case without spaces, or as they stand.
CACHE = {False: 700_000, True: 1_400_000}
#: Chunks given to the library in one call.
CALL = 2000
#: The most common chunks have a small dictionary of their own, which stays in the processor's cache; chunks counted for it.
HOT, COUNTED = 1 << 15, 1_500_000
#: Key of the end id behind each text: no chunk's key holds a space.
END = " "
#: Stands before a chunk that no space precedes.
BARE = "\x01"
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
#: Punctuation between a Latin letter and the end of a chunk: the libraries' patterns cut it off as one piece. No apostrophes: they may belong to a word's end.
_TAIL = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[A-Za-zÀ-ÖØ-öø-ÿ][!-&(-/:-@\[-`{-~])[!-&(-/:-@\[-`{-~]*(?= |\Z)")
#: White space that a spaced vocabulary's text may not hold if its chunks are to be cached (fixed values of Unicode), and meetings of white space.
_ODD_ASCII = ["  ", "\n\n", " \n", "\n ", BARE, *map(chr, [9, 11, 12, 13, 28, 29, 30, 31])]
_ODD = [*_ODD_ASCII, *map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]

#: White space of Python's split() that is none to the library.
_NOT_SPACE = list(map(chr, [28, 29, 30, 31]))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_SPACE = _LETTERS[32]


def _is_latin(text: str) -> bool:
    """Whether all characters are below 256: then lower case needs no context and nothing is decomposed."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class ChunkEncoder:
    """encode(texts) -> (ids of all texts one after the other, each with the end id behind it; number of ids of each)."""

    def __init__(self, path: str, spaced: bool, end: int = 0):
        """spaced: the vocabulary keeps the space before a word; else words end in a mark and are in lower case."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.end = spaced, end
        #: Contents of added tokens, in lower case where the vocabulary is.
        self.added = [t.content if spaced else t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: The special token whose id is the largest; between chunks it cuts one long call into their ids.
        self.mark_id, self.mark = max((k, v.content) for k, v in self.tokenizer.get_added_tokens_decoder().items())
        #: The merge model alone, for words that are already in the vocabulary's letters.
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = CharDelimiterSplit(" ")
        edge = [k for t, k in self.tokenizer.get_vocab().items() if (t.startswith(_SPACE) if spaced else t.endswith("</w>"))]
        self.edge = np.zeros(self.mark_id + 1, bool)
        self.edge[edge] = True
        self.hot: dict[str, int] = {}
        self.seen: Counter | None = Counter()
        self.reset()

    def reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.at = np.zeros(1 << 18, np.int64)
        self.size = np.zeros(1 << 18, np.int64)
        self.used = 0
        self.add([END], np.array([self.end], np.uint32), np.ones(1, np.int64))
        self._warm(list(self.hot))

    def _warm(self, common: list[str]) -> None:
        self.learn([k for k in common if k not in self.slot])
        self.hot = {k: self.slot[k] for k in common}

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, new, total = len(self.slot), len(keys), len(ids)
        while n + new > len(self.at):
            self.at, self.size = np.concatenate([self.at, self.at * 0]), np.concatenate([self.size, self.size * 0])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        ends = np.cumsum(sizes)
        self.at[n : n + new], self.size[n : n + new] = self.used + ends - sizes, sizes
        self.flat[self.used : self.used + total] = ids
        self.used += total
        self.slot.update(zip(keys, range(n, n + new), strict=True))

    def text_of(self, key: str) -> str:
        if not self.spaced or key == "\n":
            return key
        return key[1:] if key[:1] == BARE else f" {key}"

    def learn(self, keys: list[str]) -> None:
        """Puts all keys into the cache."""
        words, parts, other = {}, [], {}
        slot = self.slot
        for key in keys:
            if key.isalpha() and key.isascii() and (self.spaced or key.islower()):
                words[key] = None
                continue
            m = _PLAIN.fullmatch(key)
            if not m:
                other[key] = None
                continue
            word, tail = m.groups()
            if not self.spaced:
                word = word.lower()
            if word not in slot:
                words[word] = None
            if tail or word != key:
                if tail and (tail := BARE + tail if self.spaced else tail) not in slot:
                    other[tail] = None
                parts.append((key, word, tail))
        own = list(words)
        for i in range(0, len(own), CALL):
            self._merge(own[i : i + CALL])
        own = list(other)
        for i in range(0, len(own), CALL):
            self._encode(own[i : i + CALL])
        if parts:
            nothing = BARE if self.spaced else ""
            if nothing not in slot:
                self.add([nothing], np.zeros(0, np.uint32), np.zeros(1, np.int64))
            none = slot[nothing]
            index = np.array([(slot[w], slot[t] if t else none) for _, w, t in parts])
            ids, _ = self.gather(index.ravel())
            self.add([k for k, _, _ in parts], ids, self.size[index].sum(1))

    def _merge(self, words: list[str]) -> None:
        if self.spaced:
            text = " ".join(_SPACE + (w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS)) for w in words)
        else:
            text = " ".join(w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS) for w in words)
        (code,) = self.merger.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(code.ids, np.uint32)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            raise AssertionError("a word's edge is missing")
        sizes = np.diff(np.append(edges, len(ids))) if self.spaced else np.diff(edges, prepend=-1)
        self.add(words, ids, sizes)

    def _encode(self, keys: list[str]) -> None:
        texts = list(map(self.text_of, keys))
        if any("<|" in t for t in texts):
            own = [c.ids for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.add(keys, np.fromiter((x for i in own for x in i), np.uint32), np.fromiter(map(len, own), np.int64, len(own)))
            return
        (code,) = self.tokenizer.encode_batch_fast([self.mark.join([*texts, ""])], add_special_tokens=False)
        ids = np.array(code.ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        self.add(keys, np.delete(ids, marks), np.diff(marks, prepend=-1) - 1)

    def keys(self, text: str) -> list[str] | None:
        """Keys of a text's chunks; None: it has to be encoded whole."""
        if not self.spaced:
            lower = text.lower()
            for x in _NOT_SPACE:
                if x in text:
                    return None
            for x in self.added:
                if x in lower:
                    return None
            if not _is_latin(text):
                return text.split()
            return _TAIL.sub(r" \g<0>", " ".join(lower.split())).split(" ")
        for x in self.added:
            if x in text:
                return None
        for x in _ODD_ASCII if text.isascii() else _ODD:
            if x in text:
                return None
        if "\n" in text:
            text = text.replace("\n", f" \n {BARE}")
        return _TAIL.sub(f" {BARE}\\g<0>", BARE + text).split(" ")

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slots one after the other, and where each slot's ids end."""
        sizes = self.size[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[index] - ends + sizes, sizes) + np.arange(total)], ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slot) > CACHE[self.spaced]:
            self.reset()
        every: list[str] = []
        counts, whole = [], {}
        for k, t in enumerate(texts):
            own = self.keys(t)
            if own is None:
                whole[k] = t
                own = []
            every += own
            every.append(END)
            counts.append(len(own) + 1)
        if self.seen is not None:
            self.seen.update(every)
        found = np.array(list(map(self.hot.get, every, repeat(-1))), np.int64)
        rare = np.flatnonzero(found < 0)
        if len(rare):
            keys = [every[i] for i in rare.tolist()]
            slots = np.array(list(map(self.slot.get, keys, repeat(-1))), np.int64)
            missing = np.flatnonzero(slots < 0)
            if len(missing):
                new = [keys[i] for i in missing.tolist()]
                self.learn(list(dict.fromkeys(new)))
                slots[missing] = list(map(self.slot.__getitem__, new))
            found[rare] = slots
        if self.seen is not None and self.seen.total() >= COUNTED:
            common, self.seen = [k for k, _ in self.seen.most_common(HOT)], None
            self._warm(common)
        ids, ends = self.gather(found)
        upto = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        if not whole:
            return ids, np.diff(upto)
        codes = dict(zip(whole, self.tokenizer.encode_batch_fast(list(whole.values()), add_special_tokens=False), strict=True))
        pieces = [np.array([*codes[k].ids, self.end], np.uint32) if k in codes else ids[upto[k] : upto[k + 1]] for k in range(len(texts))]
        return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> ChunkEncoder:
    """One encoder for each worker process and file; its cache serves all of the worker's tasks."""
    return ChunkEncoder(path, spaced)

