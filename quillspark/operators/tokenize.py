"""Words of texts: as arrays, as rows, and as rows with their offsets in the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.language import ENGLISH, Language


def words(text: str | Column, language: Language = ENGLISH) -> Column:
    """Array of the words of a text, in order; null for null."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(language.pattern), 0)


def explode_words(df: DataFrame, text: str = "text", language: Language = ENGLISH, name: str = "word") -> DataFrame:
    """A row for each word; the text is left out."""
    return df.select(*[c for c in df.columns if c != text], F.explode(words(text, language)).alias(name))


def tokens(df: DataFrame, text: str = "text", language: Language = ENGLISH) -> DataFrame:
    """Rows of pos (0-based), offset, len (characters), byte_offset and word for each word; the text is left out.

    A leading begin character counts for offset and length but is no part of word; a trailing end character is.
    Offsets depend on all that comes before, so one Arrow pass finds them."""
    pattern = language.pattern
    skip = len(language.begin) > 0
    others = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)

    def run(batches):
        import pyarrow as pa
        import regex

        find = regex.compile(pattern).finditer
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                index, rows = [], []
                for k, t in enumerate(part.column(part.schema.get_field_index(text)).to_pylist()):
                    if not t:
                        continue
                    ascii_only = t.isascii()
                    seen = at = 0
                    for pos, m in enumerate(find(t)):
                        start, word = m.start(), m.group()
                        if ascii_only:
                            at = start
                        else:
                            at += len(t[seen:start].encode("utf-8", "surrogatepass"))
                            seen = start
                        index.append(k)
                        rows.append((pos, start, len(word), at, word[1:] if skip and word[0] in language.begin else word))
                if rows:
                    kept = part.select(others).take(pa.array(index))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*others, "pos", "offset", "len", "byte_offset", "word"])

    return df.select(*others, text).mapInArrow(run, f"{schema}{', ' if schema else ''}pos int, offset int, len int, byte_offset int, word string")
