"""Dictionaries as tables: build, load, merge; personal and replacement lists; catalogue and selection.

A dictionary has the columns word, aff (affix flags, may be empty), clean (lookup key), soundslike. A written one is a
Parquet folder sorted by soundslike and word; language and soundslike version stand in each file's metadata columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.language import ENGLISH, Language, clean, is_valid, soundslike
from quillspark.storage import stage

#: Suffixes that a dictionary name is tried with, in order (fixed values).
SUFFIXES = ("", ".multi", ".alias", ".spcl", ".special", ".pws", ".prepl")
MAX_BYTES = 240


class DictionaryError(ValueError):
    """A dictionary that cannot be used: another language, another soundslike, a bad header."""


def word_list(lines: DataFrame, language: Language = ENGLISH, validate: bool = True, clean_words: bool = False, skip_invalid: bool = True) -> DataFrame:
    """word, aff from lines (value): ``word`` or ``word/FLAGS``. Invalid words are skipped, or stop the job."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\r$", "")), "/", 2)
    rows = lines.select(parts[0].alias("word"), F.coalesce(F.get(parts, 1), F.lit("")).alias("aff")).where("word <> ''")
    if clean_words:
        rows = rows.withColumn("word", strip_edges("word", language))
    good = is_valid("word", language) & (F.octet_length("word") <= MAX_BYTES)
    if not validate:
        return rows
    if skip_invalid:
        return rows.where(good)
    return rows.withColumn("word", F.when(good, F.col("word")).otherwise(F.raise_error(F.concat(F.lit("invalid word: "), F.col("word")))))


def strip_edges(word, language: Language = ENGLISH):
    """A word without characters at its edges that cannot stand there."""
    begin = language._set(language.begin) + "?" if language.begin else ""
    end = language._set(language.end) + "?" if language.end else ""
    return F.regexp_extract(word, rf"({begin}\p{{L}}.*\p{{L}}{end}|{begin}\p{{L}}{end})", 1)


def build(words: DataFrame, language: Language = ENGLISH) -> DataFrame:
    """A dictionary from (word, aff): equal words become one with all their flags in first-seen (alphabetical) order."""
    flags = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.split("aff", ""))))), "")
    merged = words.groupBy("word").agg(flags.alias("aff"))
    return merged.select("word", "aff", clean("word", language.store_as).alias("clean"), soundslike("word", language.soundslike).alias("soundslike"))


def duplicates(dictionary: DataFrame) -> DataFrame:
    """dictionary with is_duplicate: another entry has the same lookup key."""
    return dictionary.withColumn("is_duplicate", F.count("*").over(Window.partitionBy("clean")) > 1)


def save(dictionary: DataFrame, path: str, language: Language = ENGLISH) -> None:
    told = dictionary.withColumns({"lang": F.lit(language.name), "soundslike_name": F.lit(language.soundslike), "soundslike_version": F.lit(language.soundslike_version)})
    told.repartitionByRange("soundslike", "word").sortWithinPartitions("soundslike", "word").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, language: Language = ENGLISH) -> DataFrame:
    df = spark.read.parquet(path)
    if missing := {"word", "aff", "clean", "soundslike", "lang", "soundslike_name", "soundslike_version"} - set(df.columns):
        raise DictionaryError(f"{path} is no dictionary: it lacks {', '.join(sorted(missing))}")
    own = df.select("lang", "soundslike_name", "soundslike_version").first()
    if own is not None and tuple(own) != (language.name, language.soundslike, language.soundslike_version):
        raise DictionaryError(f"{path} is for {tuple(own)}")
    return df.select("word", "aff", "clean", "soundslike")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def resolve(spark: SparkSession, name: str, folders: tuple[str, ...] = ("",)) -> str:
    """The path of a dictionary: its name with the first suffix that exists, in the first folder that has it."""
    for folder in ("",) if name.startswith("/") or "://" in name else folders:
        for suffix in SUFFIXES:
            path = f"{folder.rstrip('/')}/{name}{suffix}" if folder else f"{name}{suffix}"
            if _exists(spark, path):
                return path
    raise DictionaryError(f"no dictionary {name} in {', '.join(f or '.' for f in folders)}")


def open_dictionary(spark: SparkSession, name: str, folders: tuple[str, ...] = ("",), aliases: dict[str, str] | None = None, language: Language = ENGLISH) -> tuple[str, DataFrame]:
    """(kind, table): words as a dictionary, or replacements as mis and cor, whichever the path holds.

    A file of ``add name`` lines is the union of the dictionaries it names, found beside it or in the folders; an alias
    stands for the lines it is given."""
    if aliases and name in aliases:
        return "words", _added(spark, aliases[name].split(";"), folders, aliases, language, name)
    path = resolve(spark, name, folders)
    if path.endswith((".multi", ".alias", ".spcl", ".special")):
        beside = path.rpartition("/")[0]
        lines = [r[0] for r in spark.read.text(path).collect()]  # as many as a file names dictionaries
        return "words", _added(spark, lines, (beside, *folders), aliases, language, path)
    columns = {"word", "aff", "clean", "soundslike"}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").limit(1).first()
    if files is None or files[0].endswith(".parquet"):
        return "words", load(spark, path, language).select(*columns)
    head = (spark.read.text(path).first() or ("",))[0].split()
    if head and head[0].startswith("personal_repl"):
        return "pairs", read_replacements(spark, path, language)
    if head and head[0].startswith(("personal_ws", "personal_wl")):
        return "words", read_personal(spark, path, language)
    return "words", build(word_list(spark.read.text(path), language, clean_words=True), language)


def _added(spark, lines: list[str], folders, aliases, language, name: str) -> DataFrame:
    parts = []
    for line in lines:
        key, _, value = line.split("#", 1)[0].strip().partition(" ")
        if key == "add":
            kind, table = open_dictionary(spark, value.strip(), folders, {k: v for k, v in (aliases or {}).items() if k != name}, language)
            if kind != "words":
                raise DictionaryError(f"{value.strip()} holds no words")
            parts.append(table)
        elif key:
            raise DictionaryError(f"{name}: unknown key {key}")
    if not parts:
        raise DictionaryError(f"{name}: there must be at least one add line")
    return parts[0] if len(parts) == 1 else union(*parts)


def union(*dictionaries: DataFrame) -> DataFrame:
    """Entries of all, with the number of the first dictionary that has them."""
    out = None
    for k, d in enumerate(dictionaries):
        one = d.select("word", "aff", "clean", "soundslike", F.lit(k).alias("dict_priority"))
        out = one if out is None else out.unionByName(one)
    best = F.min(F.struct("dict_priority", "aff", "clean", "soundslike")).alias("x")
    return out.groupBy("word").agg(best).select("word", "x.aff", "x.clean", "x.soundslike", "x.dict_priority")


def frequency_dictionary(docs: DataFrame, least: int = 3, lang: str | None = "en", language: Language = ENGLISH) -> DataFrame:
    """Lower-case words found in at least `least` documents (doc_id, text, lang), as a dictionary with doc_freq."""
    from quillspark.operators.tokenize import words

    own = docs if lang is None else docs.where(F.col("lang") == lang)
    # a document's distinct words first: then a plain count is the number of documents
    each = own.select(F.explode(F.array_distinct(F.transform(words("text", language), F.lower))).alias("word"))
    kept = each.groupBy("word").agg(F.count("*").alias("doc_freq")).where(F.col("doc_freq") >= least)
    return kept.select("word", F.lit("").alias("aff"), clean("word", language.store_as).alias("clean"), soundslike("word", language.soundslike).alias("soundslike"), "doc_freq")


# Personal and replacement lists: text files with a header line.

_ESCAPES = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "#": "\\#"}


def escape(line: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in line)


def unescape(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), line)


def _header(spark: SparkSession, path: str, kinds: tuple[str, ...], language: Language) -> str:
    first = spark.read.text(path).first()
    parts = (first[0] if first else "").split()
    if len(parts) < 2 or parts[0] not in kinds:
        raise DictionaryError(f"{path}: not one of {', '.join(kinds)}")
    if parts[1] != language.name:
        raise DictionaryError(f"{path} is for language {parts[1]}")
    return first[0]


def _unescaped(column: str):
    return F.regexp_replace(F.regexp_replace(column, r"\\n", "\n"), r"\\(.)", "$1")


def read_personal(spark: SparkSession, path: str, language: Language = ENGLISH) -> DataFrame:
    """A personal list as a dictionary."""
    head = _header(spark, path, ("personal_ws-1.1", "personal_wl"), language)
    lines = spark.read.text(path).where((F.col("value") != head) & (F.trim("value") != ""))
    return build(lines.select(_unescaped("value").alias("word"), F.lit("").alias("aff")), language)


def personal_lines(dictionary: DataFrame, language: Language = ENGLISH) -> DataFrame:
    """value: the header and the words of a personal list, sorted by bytes."""
    n = dictionary.agg(F.format_string(f"personal_ws-1.1 {language.name} %d utf-8", F.count("*")).alias("value"))
    escaped = F.regexp_replace("word", r"([\\#])", r"\\$1").alias("value")
    return n.select(F.lit(0).alias("k"), "value").unionByName(dictionary.select(F.lit(1).alias("k"), escaped)).orderBy("k", "value").select("value")


def save_personal(dictionary: DataFrame, path: str, language: Language = ENGLISH) -> None:
    """Writes one file. Words of a list that is there already stay in it."""
    spark = dictionary.sparkSession
    if _exists(spark, path):
        there = stage(read_personal(spark, path, language), "personal")
        dictionary = union(there, dictionary)
    personal_lines(dictionary, language).coalesce(1).write.mode("overwrite").text(path)


def save_replacements(pairs: DataFrame, path: str, language: Language = ENGLISH) -> None:
    """Writes one file. Pairs of a list that is there already stay in it."""
    spark = pairs.sparkSession
    if _exists(spark, path):
        pairs = stage(read_replacements(spark, path, language), "replacements").unionByName(pairs.select("mis", "cor"))
    replacement_lines(pairs, language).coalesce(1).write.mode("overwrite").text(path)


def read_replacements(spark: SparkSession, path: str, language: Language = ENGLISH) -> DataFrame:
    """mis, cor from a replacement list: split at the first space."""
    head = _header(spark, path, ("personal_repl-1.1", "personal_repl"), language)
    lines = spark.read.text(path).where((F.col("value") != head) & F.col("value").rlike(r"^\S+ \S"))
    parts = F.split(_unescaped("value"), " ", 2)
    return lines.select(parts[0].alias("mis"), parts[1].alias("cor")).distinct()


def replacement_lines(pairs: DataFrame, language: Language = ENGLISH) -> DataFrame:
    head = pairs.limit(1).agg(F.lit(f"personal_repl-1.1 {language.name} 0 utf-8").alias("value"))
    rows = pairs.distinct().select(F.lit(1).alias("k"), "mis", "cor", F.concat_ws(" ", "mis", "cor").alias("value"))
    return head.select(F.lit(0).alias("k"), F.lit("").alias("mis"), F.lit("").alias("cor"), "value").unionByName(rows).orderBy("k", "mis", "cor").select("value")


def read_pairs(spark: SparkSession, path: str, keyword: str = "rep") -> DataFrame:
    """from, to of a table of ``REP from to`` lines; the count line, empty and identity pairs are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where((F.lower(parts[0]) == keyword) & (F.size(parts) == 3))
    return rows.select(clean(parts[1]).alias("from"), clean(parts[2]).alias("to")).where("`from` <> '' and `from` <> `to`")


def read_keyboard(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(a, b) of neighbouring keys, and the groups of characters on one key (``key`` lines; a driver-side file)."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("value")).where("value <> ''")
    pairs = lines.where(F.length("value") == 2).select(F.substring("value", 1, 1).alias("a"), F.substring("value", 2, 1).alias("b"))
    keys = [r[0].split()[1] for r in lines.where("value like 'key %'").collect()]  # as many as a keyboard has keys
    return pairs, keys


def front_coded(words: DataFrame) -> DataFrame:
    """prefix, rest: how many characters a sorted list's word shares with the one before it, and what follows.

    Ranges of words are coded on their own: the first of each range stands in full."""
    ranged = words.select("word").distinct().withColumn("block", F.substring("word", 1, 2))
    before = F.lag("word").over(Window.partitionBy("block").orderBy("word"))
    shared = F.aggregate(F.sequence(F.lit(1), F.least(F.length("word"), F.length("_b"))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring("word", i, F.lit(1)) == F.substring("_b", i, F.lit(1))), i).otherwise(n))
    coded = ranged.withColumn("_b", before)
    prefix = F.when(F.col("_b").isNull() | (F.length("_b") == 0), 0).otherwise(shared)
    return coded.select("block", "word", prefix.alias("prefix")).withColumn("rest", F.col("word").substr(F.col("prefix") + 1, F.length("word")))


_NAME = re.compile(r"(?P<code>[a-z]{2,3}(?:_[A-Z]{2})?)(?:-(?P<variety>(?!\d)[^-]+(?:-(?!\d)[^-]+)*?))??(?:-(?P<size>\d+))?(?:-(?P<module>[^-\d][^-]*))?")


def catalogue(spark: SparkSession, names: list[str]) -> DataFrame:
    """name, code, variety, size, module of dictionary file names (``code[-variety][-size][-module].multi``)."""
    rows = []
    for name in names:
        base, _, suffix = name.rpartition(".")
        m = _NAME.fullmatch(base) if suffix in ("awli", "multi", "alias") else None
        if m:
            rows.append((base, m["code"], m["variety"] or "", m["size"] or "60", m["module"] or "default"))
    return spark.createDataFrame(rows, "name string, code string, variety string, size string, module string")


def select(catalogue: DataFrame, code: str, variety: str = "", size: str = "+60", module: str = "default") -> DataFrame:
    """The best entry: by code (exact, then the bare language), variety, module, then size: ``60`` nearest, ``+60`` nearest and rather larger, ``-60`` rather smaller."""
    want, sign = int(size.lstrip("+-<>")), size[:1]
    n = F.col("size").cast("int")
    side = F.when(n >= want, 0).otherwise(1) if sign in "+>" else F.when(n <= want, 0).otherwise(1) if sign in "-<" else F.lit(0)
    order = [F.when(F.col("code") == code, 0).otherwise(1), F.when(F.col("variety") == variety, 0).otherwise(1), F.when(F.col("module") == module, 0).otherwise(1), side, F.abs(n - want), "name"]
    return catalogue.where((F.col("code") == code) | (F.col("code") == code.split("_")[0])).orderBy(*order).limit(1)
