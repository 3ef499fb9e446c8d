"""Membership: which words a dictionary accepts, which it lacks; compounds, camel case, affixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.language import ENGLISH, Language, accepts, clean, split_camel, title
from quillspark.operators.tokenize import explode_words, tokens


def correct(words: DataFrame, dictionary: DataFrame, word: str = "word", language: Language = ENGLISH, ignore_case: bool = False, ignore: int = 1) -> DataFrame:
    """Rows of words that are no longer than ignore or that an entry of dictionary (word, clean) accepts."""
    return _looked_up(words, dictionary, word, language, ignore_case, ignore, "left_semi").unionByName(words.where(F.length(word) <= ignore))


def incorrect(words: DataFrame, dictionary: DataFrame, word: str = "word", language: Language = ENGLISH, ignore_case: bool = False, ignore: int = 1) -> DataFrame:
    """Rows of words that are longer than ignore and that no entry accepts."""
    return _looked_up(words, dictionary, word, language, ignore_case, ignore, "left_anti")


def _looked_up(words, dictionary, word, language, ignore_case, ignore, how) -> DataFrame:
    entries = dictionary.select(F.col("word").alias("_entry"), F.col("clean").alias("_clean"))
    long = words.where(F.length(word) > ignore)
    return long.join(entries, (clean(word, language.store_as) == F.col("_clean")) & accepts(word, "_entry", language, ignore_case), how)


def with_verdict(words: DataFrame, dictionary: DataFrame, word: str = "word", language: Language = ENGLISH, ignore_case: bool = False, ignore: int = 1) -> DataFrame:
    """words with is_correct. Each distinct word is looked up once."""
    distinct = words.select(F.col(word).alias("_w")).distinct()
    bad = incorrect(distinct, dictionary, "_w", language, ignore_case, ignore).withColumn("_bad", F.lit(True))
    return words.join(bad, words[word].eqNullSafe(bad["_w"]), "left").withColumn("is_correct", F.col("_bad").isNull()).drop("_w", "_bad")


def misspelled(docs: DataFrame, dictionary: DataFrame, language: Language = ENGLISH, **options) -> DataFrame:
    """Tokens with offsets that no entry accepts."""
    return incorrect(tokens(docs, language=language), dictionary, language=language, **options)


def misspelled_counts(docs: DataFrame, dictionary: DataFrame, language: Language = ENGLISH, **options) -> DataFrame:
    """Distinct unknown words and how often they occur: words are counted before they are looked up."""
    counted = explode_words(docs.select("text"), language=language).groupBy("word").agg(F.count("*").alias("n"))
    return incorrect(counted, dictionary, language=language, **options)


def lookup_clean(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """All entries that share the clean key of a word."""
    return words.join(dictionary.select(F.col("word").alias("entry"), F.col("clean").alias("_clean")), clean(word) == F.col("_clean")).drop("_clean")


def lookup_soundslike(words: DataFrame, dictionary: DataFrame, key: Column, word: str = "word") -> DataFrame:
    """All entries (word, soundslike) that sound like a word; key: its soundslike."""
    return words.withColumn("_s", key).join(dictionary.select(F.col("word").alias("entry"), F.col("soundslike").alias("_s")), "_s").drop("_s")


def camel_correct(words: DataFrame, dictionary: DataFrame, word: str = "word", **options) -> DataFrame:
    """words with is_correct, n_wrong and first_wrong: a word that fails as a whole is judged by its camel-case parts."""
    whole = with_verdict(words.select(F.col(word).alias("_word")).distinct(), dictionary, "_word", **options)
    parts = whole.where("not is_correct").select("_word", F.posexplode(split_camel("_word")).alias("pos", "part"))
    judged = with_verdict(parts, dictionary, "part", **options).groupBy("_word").agg(
        F.bool_and("is_correct").alias("_all"),
        F.count("*").alias("_n"),
        F.sum((~F.col("is_correct")).cast("int")).alias("_wrong"),
        F.min(F.when(~F.col("is_correct"), F.struct("pos", "part"))).alias("_first"),
    )
    by_parts = F.col("is_correct") | F.coalesce(F.col("_all") & (F.col("_n") > 1), F.lit(False))
    told = whole.join(judged, "_word", "left").withColumn("is_correct", by_parts).select(
        "_word",
        "is_correct",
        F.when(F.col("is_correct"), 0).otherwise(F.coalesce("_wrong", F.lit(1))).alias("n_wrong"),
        F.when(~F.col("is_correct"), F.coalesce(F.col("_first.part"), F.col("_word"))).alias("first_wrong"),
    )
    return words.join(told, words[word].eqNullSafe(told["_word"])).drop("_word")


def run_together(words: DataFrame, dictionary: DataFrame, word: str = "word", limit: int = 2, least: int = 3, ignore: int = 1, ignore_case: bool = False, language: Language = ENGLISH) -> DataFrame:
    """word and parts for words that split into 2 to limit (8 at most) entries of at least `least` letters.

    Of several splits the one with the fewest parts, then the shortest first parts, is given. Later parts may need a
    title-case first letter to be accepted if the word starts with one."""
    limit = min(limit, 8)
    open_ = words.select(F.col(word).alias("word")).distinct().select("word", F.col("word").alias("rest"), F.array().cast("array<string>").alias("parts"))
    done = None
    for k in range(limit - 1):
        cut = open_.where(F.length("rest") >= 2 * least).withColumn("at", F.explode(F.sequence(F.lit(least), F.length("rest") - least)))
        cut = cut.withColumn("part", F.substring("rest", F.lit(1), F.col("at"))).withColumn("rest", F.col("rest").substr(F.col("at") + 1, F.length("rest")))
        heads = _parts_accepted(cut, dictionary, "part", language, ignore_case, ignore)
        ends = _parts_accepted(heads, dictionary, "rest", language, ignore_case, ignore).select("word", F.concat("parts", F.array("part", "rest")).alias("parts"))
        done = ends if done is None else done.unionByName(ends)
        if k < limit - 2:
            open_ = heads.select("word", "rest", F.concat("parts", F.array("part")).alias("parts"))
    if done is None:
        return open_.where("false").select("word", "parts")
    order = F.struct(F.size("parts").alias("n"), F.transform("parts", F.length).alias("sizes"), F.col("parts"))
    return done.groupBy("word").agg(F.min(order).alias("x")).select("word", F.col("x.parts").alias("parts"))


def _parts_accepted(rows, dictionary, part, language, ignore_case, ignore) -> DataFrame:
    """Rows whose part an entry accepts as it stands or, in a word that starts in upper case, as a title."""
    entries = dictionary.select(F.col("word").alias("_entry"), F.col("clean").alias("_clean"))
    first = F.substring("word", 1, 1)
    titled = (first == F.upper(first)) & (first != F.lower(first))
    fits = accepts(part, "_entry", language, ignore_case) | (titled & accepts(title(part), "_entry", language, ignore_case))
    return rows.join(entries, (clean(part, language.store_as) == F.col("_clean")) & fits, "left_semi")

