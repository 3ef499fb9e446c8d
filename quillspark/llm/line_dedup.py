"""Line deduplication by overlapping windows of three consecutive lines; DataFrame functions only.

Lines end at \\n; blank lines (white space only) are kept and passed over. Every three consecutive other lines,
trimmed, make a window. The first occurrence of a window, by (doc_id, text, position), stays; all lines that a
later occurrence covers go. A text with fewer than three such lines has no window and stays as it is.

Null texts stay null; empty texts stay empty. Null doc_ids come first and count as one id. Rows that repeat doc_id
and text are one document: all get the same result. Extra columns of any name are passed on, but for n_lines and
n_removed, which line_dedup() replaces by its own; keep_lines() returns all columns as they came. An empty table
stays empty. A passage that very many documents share is joined in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import field, quoted, skewed_join, stage

WINDOW = 3
_TRIM = " \t\r\x0b\x0c"


def _lines() -> Column:
    return F.split("text", "\n")


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, window hashes, first and last line of each window."""
    marked = F.transform(_lines(), lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(_TRIM)).alias("line")))
    hashed = F.transform(F.filter(marked, lambda x: x["line"] != ""), lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("h"), F.hash(x["line"]).alias("g")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), hashed.alias("lines")).where(F.size("lines") >= WINDOW)
    spans = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (WINDOW - 1)),
        lambda i: F.struct(
            F.xxhash64(*[F.element_at("lines", i + k)["h"] for k in range(WINDOW)]).alias("h"),
            F.xxhash64(*[F.element_at("lines", i + k)[f] for k in reversed(range(WINDOW)) for f in ("g", "h")]).alias("g"),
            F.element_at("lines", i)["at"].alias("start"),
            F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.element_at("lines", i + k)["at"]).alias("covers"),
        ),
    )
    return rows.select("doc_id", "text_hash", F.explode(spans).alias("w")).select("doc_id", "text_hash", "w.*")


def later_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, positions: the lines that later occurrences of repeated windows cover."""
    windows = stage(_windows(docs), "windows")
    place = F.struct("doc_id", "text_hash", "start")
    repeated = stage(windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1"), "repeated")
    later = skewed_join(windows, repeated.drop("size"), ["h", "g"], sizes=repeated).where(place > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("positions"))


def _cut(docs: DataFrame) -> DataFrame:
    """doc (all columns of docs), text (cut), n_lines, n_removed."""
    gone = later_lines(docs).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), "doc_id", "text", F.xxhash64("text").alias("own"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("text_hash")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(_lines()) - 1), "positions")
    text = F.when(F.col("positions").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(_lines(), i)), "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines())).cast("long")
    return joined.select("doc", text.alias("text"), count.alias("n_lines"), F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_removed"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with later repeats cut from text; n_lines and n_removed are added (null texts: 0)."""
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return _cut(docs).select(*[F.col("text").alias(c) if c.lower() == "text" else field("doc", c) for c in own], "n_lines", "n_removed")


def keep_lines(docs: DataFrame) -> DataFrame:
    """docs with repeats cut and n_chars, where there is one, renewed; a document that loses all its lines goes."""
    cut = _cut(docs).where(~((F.col("n_removed") > 0) & (F.trim("text", F.lit(_TRIM + "\n")) == "")))
    types = {f.name: f.dataType for f in docs.schema}

    def value(c: str) -> Column:
        if c.lower() == "text":
            return F.col("text").alias(c)
        old = F.col("doc").getField(c)
        return F.when(F.col("n_removed") > 0, F.length("text").cast(types[c])).otherwise(old).alias(c) if c.lower() == "n_chars" else old.alias(c)

    return cut.select(*map(value, docs.columns))
