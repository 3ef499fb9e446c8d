"""Options: their types and defaults, ``key value`` files, list actions, and the order in which settings count.

Read and kept so that existing settings load, but without effect on tables: encoding and the norm options (text is
Unicode; see functions.encoding), ignore-accents, partially-expand, invisible-soundslike, time, backup; variety and
size (see sources.dictionaries.select); the word and affix checks (see sources.dictionaries.word_list), guess.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

#: Name: type and default (fixed values). Lists hold strings.
OPTIONS: dict[str, tuple[str, object]] = {
    "encoding": ("string", "utf-8"),
    "filter": ("list", ("url",)),
    "mode": ("string", "url"),
    "extra-dicts": ("list", ()),
    "wordlists": ("list", ()),
    "dict-alias": ("list", ()),
    "ignore": ("int", 1),
    "ignore-accents": ("bool", False),
    "ignore-case": ("bool", False),
    "ignore-repl": ("bool", False),
    "save-repl": ("bool", True),
    "keyboard": ("string", "standard"),
    "lang": ("string", "en"),
    "master": ("string", ""),
    "variety": ("list", ()),
    "size": ("string", "+60"),
    "normalize": ("bool", True),
    "norm-required": ("bool", False),
    "norm-form": ("string", "nfc"),
    "norm-strict": ("bool", False),
    "personal": ("string", ""),
    "repl": ("string", ""),
    "run-together": ("bool", False),
    "run-together-limit": ("int", 2),
    "run-together-min": ("int", 3),
    "camel-case": ("bool", False),
    "sug-mode": ("string", "normal"),
    "sug-typo-analysis": ("bool", True),
    "sug-repl-table": ("bool", True),
    "sug-split-char": ("list", (" ", "-")),
    "use-other-dicts": ("bool", True),
    "affix-compress": ("bool", False),
    "partially-expand": ("bool", False),
    "invisible-soundslike": ("bool", False),
    "clean-words": ("bool", False),
    "clean-affixes": ("bool", True),
    "skip-invalid-words": ("bool", True),
    "validate-words": ("bool", True),
    "validate-affixes": ("bool", True),
    "guess": ("bool", False),
    "suggest": ("bool", True),
    "reverse": ("bool", False),
    "time": ("bool", False),
    "byte-offsets": ("bool", False),
    "backup": ("bool", True),
}


class OptionError(ValueError):
    """An unknown key, or a value that its type does not allow."""


def split_list(text: str) -> list[str]:
    """Values between colons; a backslash takes the next character as it is."""
    return [re.sub(r"\\(.)", r"\1", x) for x in re.findall(r"(?:[^:\\]|\\.)+", text)]


def join_list(values: Iterable[str]) -> str:
    return ":".join(re.sub(r"([:\\])", r"\\\1", v) for v in values)


def itemize(text: str) -> list[tuple[str, str]]:
    """(action, item) of a comma list: + or nothing adds, - removes, ! clears all."""
    out = []
    for item in (x.strip() for x in text.split(",")):
        if item == "!":
            out.append(("!", ""))
        elif item:
            out.append((item[0], item[1:].strip()) if item[0] in "+-" else ("+", item))
    return out


@dataclass(frozen=True)
class Options:
    """Settings on top of the defaults. Later sources win: global file, personal file, environment, caller."""

    values: Mapping[str, object]

    @staticmethod
    def of(*sources: Mapping[str, str] | str) -> Options:
        """sources: from the weakest to the strongest; text is read as a file."""
        out = Options({})
        for s in sources:
            for key, value in parse_lines(s) if isinstance(s, str) else s.items():
                out = out.set(key, value)
        return out

    def __getitem__(self, key: str):
        if key not in OPTIONS:
            raise OptionError(f"unknown key: {key}")
        return self.values.get(key, OPTIONS[key][1])

    def set(self, key: str, value: object) -> Options:
        """A copy with one setting. Prefixes act on it: add-, rem-, lset-, clear-, reset-, enable-, dont-, disable-."""
        m = None if key in OPTIONS else re.fullmatch(r"(add|rem|remove|lset|clear|reset|enable|dont|disable)-(.+)", key)
        action, name = (m[1], m[2]) if m else ("", key)
        if name not in OPTIONS:
            raise OptionError(f"unknown key: {key}")
        kind, now = OPTIONS[name][0], self[name]
        if action in ("add", "rem", "remove", "lset", "clear") and kind != "list":
            raise OptionError(f"{name} is no list")
        if action in ("enable", "dont", "disable") and kind != "bool":
            raise OptionError(f"{name} is no switch")
        if action == "reset":
            return Options({k: v for k, v in self.values.items() if k != name})
        if action == "add":
            new: object = (*(v for v in now if v != value), str(value))
        elif action in ("rem", "remove"):
            new = tuple(v for v in now if v != value)
        elif action == "clear":
            new = ()
        elif action in ("enable", "dont", "disable"):
            new = action == "enable"
        else:
            new = _typed(name, kind, value)
        return Options({**self.values, name: new})


def _typed(name: str, kind: str, value: object) -> object:
    if kind == "list":
        return tuple(split_list(value)) if isinstance(value, str) else tuple(value)
    if kind == "bool":
        if value in (True, False):
            return bool(value)
        if value not in ("true", "false"):
            raise OptionError(f"{name} is true or false, not {value!r}")
        return value == "true"
    if kind == "int":
        if not re.fullmatch(r"\d+", str(value)):
            raise OptionError(f"{name} is a number from 0, not {value!r}")
        return int(value)
    return str(value)


def parse_lines(text: str) -> list[tuple[str, str]]:
    """(key, value) of ``key value`` lines or ``;`` lists; # starts a comment."""
    out = []
    for line in re.split(r"[\n;]", text):
        line = re.sub(r"(?<!\\)#.*", "", line).strip()
        if line:
            key, _, value = line.partition(" ")
            out.append((key, value.strip()))
    return out
