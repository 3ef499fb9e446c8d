"""Language rules as column expressions: letter case, accents, lookup keys, case patterns, word validity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain letters, position by position (fixed values of the Latin alphabet).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"
VOWELS = "aeiou"


@dataclass(frozen=True)
class Language:
    """What tells words apart. begin, middle, end: characters that may stand before, within, behind a word."""

    name: str = "en"
    begin: str = ""
    middle: str = "'"
    end: str = ""
    soundslike: str = "simple"
    soundslike_version: str = "1"
    store_as: str = "stripped"

    @staticmethod
    def _set(chars: str) -> str:
        return "[" + "".join(f"\\{c}" for c in chars) + "]"

    @property
    def pattern(self) -> str:
        """Regular expression of a token, for Spark and DuckDB alike."""
        head = f"{self._set(self.begin)}?" if self.begin else ""
        inner = rf"\p{{L}}+({self._set(self.middle)}\p{{L}}+)*" if self.middle else r"\p{L}+"
        tail = f"{self._set(self.end)}?" if self.end else ""
        return head + inner + tail


ENGLISH = Language()


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def title(word: str | Column) -> Column:
    """First character in upper case, the rest as it is."""
    w = _c(word)
    return F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))


def de_accent(word: str | Column) -> Column:
    return F.translate(_c(word), ACCENTED, PLAIN)


def stripped(word: str | Column) -> Column:
    """Lower case without accents."""
    return de_accent(F.lower(_c(word)))


def clean(word: str | Column, store_as: str = "stripped") -> Column:
    """The key under which all case and accent variants of a word meet: letters only."""
    base = stripped(word) if store_as == "stripped" else F.lower(_c(word))
    return F.regexp_replace(base, r"[^\p{L}]", "")


def case_pattern(word: str | Column) -> Column:
    """AllLower, AllUpper, FirstUpper or Other; the first letter decides between the last two."""
    w = _c(word)
    first, rest = F.regexp_extract(w, r"^[^\p{L}]*(\p{L})", 1), F.regexp_extract(w, r"^[^\p{L}]*\p{L}(.*)$", 1)
    return F.when(w == F.lower(w), "AllLower").when(w == F.upper(w), "AllUpper").when((first == F.upper(first)) & (rest == F.lower(rest)), "FirstUpper").otherwise("Other")


def word_info(word: str | Column) -> Column:
    """Case pattern, and whether the word is without accents and equal to its own lookup key."""
    w = _c(word)
    return F.struct(case_pattern(w).alias("case"), (w == de_accent(w)).alias("all_plain"), (w == clean(w)).alias("all_clean"))


def fix_case(pattern: str | Column, word: str | Column) -> Column:
    """A suggestion in the case of the word that was typed."""
    p, w = _c(pattern), _c(word)
    first = F.substring(w, 1, 1)
    return F.when(p == "AllUpper", F.upper(w)).when((p == "FirstUpper") & (first == F.lower(first)), title(w)).otherwise(w)


def split_camel(word: str | Column) -> Column:
    """Parts of a camel-case word; the last of several upper-case letters belongs to the next part."""
    return F.regexp_extract_all(_c(word), F.lit(r"\p{Lu}?[\p{L}&&[^\p{Lu}]]+|\p{Lu}+(?![\p{L}&&[^\p{Lu}]])"), 0)


def is_valid(word: str | Column, language: Language = ENGLISH) -> Column:
    return F.coalesce(_c(word).rlike(f"^{language.pattern}$"), F.lit(False))


def accepts(word: str | Column, entry: str | Column, language: Language = ENGLISH, ignore_case: bool = False) -> Column:
    """Whether a dictionary entry accepts a word: as it stands, with its first letter or all letters in upper case.

    A leading begin character and one trailing end character of the word may be passed over."""
    w, d = _c(word), _c(entry)
    forms = [w]
    if language.end:
        forms.append(F.regexp_replace(w, f"{language._set(language.end)}$", ""))
    if language.begin:
        forms += [F.regexp_replace(x, f"^{language._set(language.begin)}+", "") for x in list(forms)]
    tests = [F.upper(x) == F.upper(d) if ignore_case else (x == d) | (x == title(d)) | (x == F.upper(d)) for x in forms]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


#: Soundslikes that were added: name to a function of a word column.
SOUNDSLIKES: dict[str, Callable[[Column], Column]] = {}


def register_soundslike(name: str, key: Callable[[Column], Column]) -> None:
    SOUNDSLIKES[name] = key


def soundslike(word: str | Column, kind: str = "simple") -> Column:
    """none: the clean key; stripped: lower without accents; simple: consonants, a leading vowel as *."""
    if kind in SOUNDSLIKES:
        return SOUNDSLIKES[kind](_c(word))
    if kind == "none":
        return clean(word)
    if kind == "stripped":
        return stripped(word)
    if kind != "simple":
        raise ValueError(f"no such soundslike: {kind}")
    letters = clean(word)
    first = F.translate(F.substring(letters, 1, 1), VOWELS, "*" * len(VOWELS))
    # vowels become one mark that keeps equal consonants around it apart, then go
    rest = F.translate(letters.substr(F.lit(2), F.length(letters)), VOWELS, "." * len(VOWELS))
    return F.regexp_replace(F.regexp_replace(F.concat(first, rest), r"([^.])\1+", "$1"), r"\.", "")


def sql_stripped(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def sql_clean(x: str) -> str:
    return f"regexp_replace({sql_stripped(x)}, '[^\\p{{L}}]', '', 'g')"


def sql_accepts(w: str, d: str) -> str:
    return f"({w} = {d} OR {w} = upper({d}[1]) || {d}[2:] OR {w} = upper({d}))"


def soundslike_alphabet(spark, language: Language = ENGLISH):
    """letter: what the language's soundslikes may hold, at their beginning or behind it."""
    letters = [c for c in map(chr, range(97, 592)) if c.isalpha()]
    rows = spark.createDataFrame([(w,) for c in letters for w in (c, f"b{c}")], "word string")
    return rows.select(F.explode(F.split(soundslike("word", language.soundslike), "")).alias("letter")).where("letter <> ''").distinct()
