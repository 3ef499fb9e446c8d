"""Queries that run as Structured Streaming over the files of a table, up to what is there, and read their sink back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import streaming
from quillspark.plans.checking import ACCEPTED, DICT, KEYED, P, dictionary, table
from quillspark.storage import shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives for the files present, written to the shared folder and read back."""
    path = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; a pattern reaches a single file as well as a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def stream_misspellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown English tokens of a stream of documents, counted after the sink."""
    docs = _source(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text")
    found = streaming.check_stream(docs, dictionary(spark, sf_dir)).select("doc_id", "offset", "word")
    return _drained(spark, found).groupBy("word").agg(F.count("*").alias("n"))


def stream_event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of event types in hourly windows of event time, and how many the dictionary lacks; a late last window stays open."""
    events = _source(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    rates = streaming.rate_stream(events, dictionary(spark, sf_dir), "ts", "1 hour", "2 hours")
    return _drained(spark, rates.select(F.col("window.start").alias("start"), "n_words", "n_unknown"))


QUERIES |= {f.__name__: f for f in (stream_misspellings, stream_event_rates)}
ORACLE_SQL["stream_misspellings"] = f"WITH {KEYED}, w AS (SELECT word, count(*) AS n FROM tok WHERE lang = 'en' GROUP BY 1) SELECT word, n FROM w WHERE length(word) > 1 AND NOT {ACCEPTED}"
ORACLE_SQL["stream_event_rates"] = f"""WITH {DICT}, w AS (SELECT CAST(ts AS TIMESTAMP) AS ts, lower(unnest(regexp_extract_all(event_type, '{P}'))) AS word FROM events)
    SELECT date_trunc('hour', ts) AS start, count(*) AS n_words, CAST(sum(CASE WHEN word IN (SELECT word FROM dict) THEN 0 ELSE 1 END) AS BIGINT) AS n_unknown FROM w
    GROUP BY 1 HAVING date_trunc('hour', ts) + INTERVAL 3 HOUR <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events)"""
