"""What a user teaches: session and personal words, replacement pairs, and pairs learnt from a log of corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.language import ENGLISH, Language, is_valid
from quillspark.operators.check import correct, incorrect
from quillspark.sources import dictionaries


def add_words(dictionary: DataFrame, words: DataFrame, language: Language = ENGLISH) -> DataFrame:
    """dictionary with the valid ones of words (word) that it does not accept yet."""
    new = incorrect(words.select("word").distinct().where(is_valid("word", language)), dictionary, language=language)
    return dictionary.select("word", "aff", "clean", "soundslike").unionByName(dictionaries.build(new.select("word", F.lit("").alias("aff")), language))


def add_pairs(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """Replacement pairs (mis, cor) with new ones; each once."""
    return pairs.select("mis", "cor").unionByName(new.select("mis", "cor")).distinct()


def learn_pairs(log: DataFrame, dictionary: DataFrame, first_suggestions: DataFrame | None = None, language: Language = ENGLISH) -> DataFrame:
    """mis, cor learnt from a log (user, at, mis, cor) of corrections, in each user's order.

    A correct correction (one word, or two by a space) is stored unless it is the first suggestion anyway
    (first_suggestions: mis, suggestion). If the correction before it was itself wrong and equals this misspelling,
    the misspelling that led there is stored as well; chains keep the oldest one."""
    halves = F.split("cor", " ", 2)
    rows = log.select("user", "at", F.lower("mis").alias("mis"), "cor", halves.alias("h"))
    parts = rows.select(F.explode("h").alias("word")).distinct()
    good = correct(parts, dictionary, language=language).select("word").distinct().withColumn("ok", F.lit(True))
    judged = rows.join(good.select(F.col("word").alias("w1"), F.col("ok").alias("ok1")), F.get("h", 0) == F.col("w1"), "left").join(good.select(F.col("word").alias("w2"), F.col("ok").alias("ok2")), F.get("h", 1) == F.col("w2"), "left")
    judged = judged.select("user", "at", "mis", "cor", (F.coalesce("ok1", F.lit(False)) & (F.coalesce("ok2", F.lit(False)) | (F.size("h") < 2))).alias("ok"))
    order = Window.partitionBy("user").orderBy("at")
    # a run of wrong corrections that feed each other has the misspelling at its head
    linked = F.lag("ok").over(order).eqNullSafe(F.lit(False)) & (F.lower(F.lag("cor").over(order)) == F.col("mis"))
    runs = judged.withColumn("head", ~F.coalesce(linked, F.lit(False))).withColumn("run", F.sum(F.col("head").cast("int")).over(order))
    chained = runs.withColumn("oldest", F.first("mis").over(Window.partitionBy("user", "run").orderBy("at")))
    stored = chained.where("ok").select(F.explode(F.array_distinct(F.array("mis", "oldest"))).alias("mis"), "cor", F.col("mis").alias("typed"))
    if first_suggestions is not None:
        same = first_suggestions.select(F.col("mis").alias("typed"), F.col("suggestion").alias("cor"))
        stored = stored.join(same.withColumn("_same", F.lit(True)), ["typed", "cor"], "left").where((F.col("_same").isNull()) | (F.col("mis") != F.col("typed")))
    return stored.select("mis", "cor").distinct()
