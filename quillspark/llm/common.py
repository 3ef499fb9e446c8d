"""What several corpus operators share: shared storage, words, small-side lookups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import storage

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that Spark hands to Python at once: long texts make Spark's default of 10,000 too many.
ARROW_ROWS = "1000"


def bound_arrow(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to ARROW_ROWS unless the session has its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ARROW_ROWS)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_arrow(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, in batches that suit long texts."""
    bound_arrow(df.sparkSession)
    return storage.stage(df, name)


def quoted(name: str) -> Column:
    """A column by its name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashable(df: DataFrame) -> list[Column]:
    """The columns of df that have a hash: all but maps and the like."""
    return [quoted(f.name) for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def field(struct: str, name: str) -> Column:
    """A field of a struct under its own name, whatever characters the name has."""
    return F.col(struct).getField(name).alias(name)


#: A key of more rows than this, and than one in HOT_SHARE of all, is joined in SALTS parts.
HOT_ROWS, HOT_SHARE, SALTS = 1000, 50_000, 64


def skewed_join(left: DataFrame, right: DataFrame, key: str | list[str], counted: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Inner join on key, of which a few values may hold most rows of left; right has one row for each.

    counted: rows of left's keys, if they are cheaper to count; or sizes: key, size. Fewer than HOT_SHARE keys are hot."""
    keys = [key] if isinstance(key, str) else key
    if sizes is None:
        sizes = (left if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("size"))
    sizes = stage(sizes.select(*keys, "size").where(F.col("size") > HOT_ROWS), "hot")
    total = sizes.agg(F.sum("size")).first()[0]
    if not total:
        return left.join(right, keys)
    hot = F.broadcast(sizes.where(F.col("size") > total // HOT_SHARE).select(*keys))
    salted = left.join(hot, keys, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*[c for c in left.columns if c not in keys]), F.lit(SALTS)).cast("int"))
    parts = right.join(hot, keys, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(hot, keys, "left_anti").join(right, keys).unionByName(salted.join(parts, [*keys, "_salt"]).drop("_salt"))


def word_count(text: str | Column) -> Column:
    """Words of a text as a long; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def batches(rows: Iterator, size: int = 128, weight: int = 1 << 20, text: int = 1) -> Iterator[list[tuple]]:
    """Cuts Arrow batches into lists of row tuples, of at most size rows and about weight characters."""
    for batch in rows:
        out, n = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch.num_rows <= size else _sliced(batch, size):
            out.append(row)
            n += len(row[text] or "")
            if len(out) >= size or n >= weight:
                yield out
                out, n = [], 0
        if out:
            yield out


def _sliced(batch, size: int) -> Iterator[tuple]:
    for i in range(0, batch.num_rows, size):
        yield from zip(*(c.to_pylist() for c in batch.slice(i, size).columns), strict=True)


def slices(batch, size: int = 128, weight: int = 1 << 20) -> Iterator:
    """Cuts an Arrow batch into slices of at most size rows, and of about weight bytes in the first column."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
    start = n = 0
    for i, length in enumerate(lengths):
        n += length
        if n >= weight or i + 1 - start >= size:
            yield batch.slice(start, i + 1 - start)
            start, n = i + 1, 0
    if start < len(lengths):
        yield batch.slice(start)
