"""Table-driven phonetic keys: a compiler for rule tables and an Arrow function that applies them.

A rule is ``PATTERN REPLACEMENT`` (``_``: nothing). PATTERN is literal letters, at most one ``(...)`` group of which one
letter must fit, then control characters in the order ``<`` (go on with the replacement), dashes (letters at the end
that stay unread), a digit (priority, 5 by default), ``^`` or ``^^`` (word start), ``$`` (word end). The first fitting
rule of a letter wins; after it, a rule of the same or a higher priority that starts at its last letter takes over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.language import ACCENTED, PLAIN

_RULE = re.compile(r"(?P<head>[^()<\-0-9^$]*)(?:\((?P<any>[^)]*)\))?(?P<again><?)(?P<back>-*)(?P<rank>\d?)(?P<start>\^{0,2})(?P<end>\$?)")
_DEACCENT = str.maketrans(ACCENTED.upper() if len(ACCENTED.upper()) == len(ACCENTED) else ACCENTED, PLAIN)


@dataclass(frozen=True)
class Rule:
    head: str
    any: str
    replacement: str
    again: bool
    back: int
    rank: int
    start: int
    end: bool

    @property
    def width(self) -> int:
        return len(self.head) + bool(self.any)

    def fits(self, word: str, at: int, first: int = 0) -> bool:
        stop = at + self.width
        if not word.startswith(self.head, at) or stop > len(word) or self.any and word[stop - 1] not in self.any:
            return False
        return not (self.start and at != first) and not (self.end and stop != len(word))


@dataclass(frozen=True)
class Phonet:
    rules: dict[str, tuple[Rule, ...]]
    version: str = ""
    followup: bool = True
    collapse: bool = True
    deaccent: bool = True
    _cache: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def parse(lines: list[str] | str) -> Phonet:
        switches, by = {"followup": "1", "collapse_result": "1", "remove_accents": "1", "version": ""}, {}
        for line in lines.splitlines() if isinstance(lines, str) else lines:
            parts = line.split("#", 1)[0].split()
            if not parts:
                continue
            key, value = parts[0], parts[1] if len(parts) > 1 else "_"
            if key in switches:
                switches[key] = value
                continue
            m = _RULE.fullmatch(key)
            if not m or not (m["head"] or m["any"]):
                raise ValueError(f"not a phonetic rule: {line!r}")
            rule = Rule(m["head"], m["any"] or "", "" if value == "_" else value, bool(m["again"]), len(m["back"]), int(m["rank"] or 5), len(m["start"]), bool(m["end"]))
            for letter in m["head"][:1] or m["any"]:
                by.setdefault(letter, []).append(rule)
        return Phonet({k: tuple(v) for k, v in by.items()}, switches["version"], switches["followup"] != "0", switches["collapse_result"] != "0", switches["remove_accents"] != "0")

    def key(self, word: str) -> str:
        text = word.upper()
        if self.deaccent:
            text = text.translate(_DEACCENT)
        out: list[str] = []
        at = first = 0
        least = -1  # priority that a rule needs on letters that a replacement put there
        while at < len(text):
            rule = next((r for r in self.rules.get(text[at], ()) if r.fits(text, at, first) and r.rank >= least), None)
            if rule is None:
                at, least = at + 1, -1
                continue
            if self.followup and not rule.back and not rule.again and rule.width > 1:
                last = at + rule.width - 1
                after = next((r for r in self.rules.get(text[last], ()) if r.width > 1 and r.rank >= rule.rank and r.fits(text, last, first)), None)
                if after is not None:  # the letters before the shared one are read by themselves
                    single = next((r for r in self.rules.get(text[at], ()) if r.width < rule.width and r.fits(text[:last], at, first)), None)
                    if single is not None:
                        out.append(single.replacement)
                        at, least = at + max(1, single.width - single.back), -1
                    else:
                        at, least = at + 1, -1
                    continue
            read = rule.width - rule.back
            if rule.again:
                text = text[:at] + rule.replacement + text[at + read :]
                if least >= 0 or not rule.replacement:
                    at, least = at + (least >= 0) * len(rule.replacement), -1
                else:
                    least = rule.rank
                continue
            out.append(rule.replacement)
            at, least = at + max(read, 0 if rule.replacement and read else 1), -1
            if rule.start == 2:
                first = at
        result = "".join(out)
        return re.sub(r"(.)\1+", r"\1", result) if self.collapse else result


def phonet_key(word: str | Column, table: Phonet) -> Column:
    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for words in parts:
            if len(known) > 500_000:
                known.clear()
            for w in words.dropna().unique():
                if w not in known:
                    known[w] = table.key(w)
            yield words.map(known)

    return run(word)
