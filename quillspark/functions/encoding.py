"""Character sets and Unicode normal forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMS = {"none": None, "nfd": "NFD", "nfc": "NFC", "comp": "NFKC", "nfkd": "NFKD", "internal": "NFC"}


def normalize(text: str | Column, form: str = "nfc") -> Column:
    """The text in a normal form; plain ASCII values pass through."""
    kind = FORMS[form]

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: t if t is None or kind is None or t.isascii() else unicodedata.normalize(kind, t))

    return run(text)


def convert(data: str | Column, source: str, target: str = "utf-8", form: str | None = None) -> Column:
    """Bytes in one character set as bytes in another; characters that the target lacks become ?."""
    text = F.decode(data, source)
    if form:
        text = normalize(text, form)
    return F.encode(text, target)


def repaired(data: str | Column) -> Column:
    """Bytes as text; each bad UTF-8 sequence becomes ?."""
    return F.regexp_replace(F.make_valid_utf8((F.col(data) if isinstance(data, str) else data).cast("string")), "�", "?")


def byte_offset(text: str | Column, offset: str | Column) -> Column:
    """Bytes before a character offset."""
    t = F.col(text) if isinstance(text, str) else text
    o = F.col(offset) if isinstance(offset, str) else offset
    return F.octet_length(F.substring(t, F.lit(1), o))
