"""Checking text that arrives as a stream: filters, words and dictionary look-up are stateless, rates are windowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.language import ENGLISH, Language, accepts, clean
from quillspark.operators.filters import apply_filters
from quillspark.operators.tokenize import tokens


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long", files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def check_stream(docs: DataFrame, dictionary: DataFrame, filters: tuple[str, ...] = (), language: Language = ENGLISH, ignore: int = 1) -> DataFrame:
    """Tokens of a stream of documents that no entry accepts: a stream-static join, no state."""
    if filters:
        docs = apply_filters(docs, filters).drop("text").withColumnRenamed("filtered", "text")
    entries = dictionary.select(F.col("word").alias("_entry"), F.col("clean").alias("_clean"))
    found = tokens(docs, language=language).where(F.length("word") > ignore)
    return found.join(entries, (clean("word", language.store_as) == F.col("_clean")) & accepts("word", "_entry", language), "left_anti")


def rate_stream(docs: DataFrame, dictionary: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes", language: Language = ENGLISH) -> DataFrame:
    """Words and unknown words in windows of event time; rows later than `late` are dropped."""
    entries = dictionary.select("word", F.lit(1).alias("_known"))
    words = docs.withWatermark(time, late).select(time, F.explode(F.regexp_extract_all("text", F.lit(language.pattern), 0)).alias("_w")).withColumn("word", F.lower("_w"))
    joined = words.join(entries, "word", "left")
    return joined.groupBy(F.window(time, window).alias("window")).agg(F.count("*").alias("n_words"), F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("n_unknown"))
