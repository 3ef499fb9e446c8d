"""Ranked corrections for unknown words: candidate joins, scores, thresholds, top-k.

Everything runs on distinct words. Candidates come from equi-joins: near words and near soundslikes meet on what is left
of either after deleting a letter or two (their deletion neighbourhoods), n-grams score all pairs of soundslikes in arrays, splits and
table replacements on the dictionary's keys. Weighted distances are computed once for each distinct pair.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.distance import FAR, STANDARD_ROWS, osa_distance, typo_distance
from quillspark.functions.language import ENGLISH, Language, case_pattern, clean, fix_case, soundslike, split_camel, stripped
from quillspark.operators import nearest
from quillspark.operators.check import correct, incorrect
from quillspark.storage import stage


@dataclass(frozen=True)
class Mode:
    """What a suggestion mode looks for and how it ranks (fixed values)."""

    name: str
    scans: tuple[int, ...]
    ngrams: bool
    soundslike_weight: int = 50
    typo_analysis: bool = True
    span: int = 50
    limit: int = 100
    skip: int = 2
    ngram_keep: int = 10
    ngram_threshold: int = 2
    repl_table: bool = True
    split_chars: tuple[str, ...] = (" ", "-")
    least: int = 3

    @property
    def searches(self) -> tuple[tuple[str, int], ...]:
        """The searches that run late, and how hard a word has to be for each."""
        return tuple(x for x, wanted in ((("scan", 1), 2 in self.scans), (("ngrams", self.ngram_threshold), self.ngrams)) if wanted)

    @property
    def word_weight(self) -> int:
        return 100 - self.soundslike_weight


MODES = {
    m.name: m
    for m in (
        Mode("ultra", (0,), False),
        Mode("fast", (0, 1), False),
        Mode("normal", (0, 1, 2), False),
        Mode("slow", (0, 1, 2), True, limit=1000, ngram_threshold=1),
        Mode("bad-spellers", (0, 1, 2), True, soundslike_weight=55, typo_analysis=False, span=125, limit=1000, ngram_threshold=1),
    )
}

#: Rows of a replacement table at most.
TABLE_ROWS = 10_000
#: Scores of edits that are no letter edits (fixed values).
SPLIT, CAMEL, CAMEL_OFF, REPLACED = 102, 101, 89, 150
FINE_SPLIT, FINE_CAMEL, FINE_CAMEL_OFF = 112, 111, 59


def queries(words: DataFrame, word: str = "word", language: Language = ENGLISH) -> DataFrame:
    """q, clean, stripped, soundslike, case of each distinct word."""
    w = F.col("q")
    rows = words.select(F.col(word).alias("q")).where("q is not null").distinct()
    return rows.select("q", clean(w, language.store_as).alias("clean"), stripped(w).alias("stripped"), soundslike(w, language.soundslike).alias("soundslike"), case_pattern(w).alias("case"))


def deletions(key: Column, edits: int) -> Column:
    """All strings that key leaves after 0 to edits deletions."""
    def once(k: Column) -> Column:
        return F.when(F.length(k) > 0, F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), k.substr(i + 1, F.length(k))))).otherwise(F.array().cast("array<string>"))

    out = F.array(key)
    for _ in range(edits):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, once))))
    return out


def near_pairs(left: DataFrame, right: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of distinct keys of left (a) and right (b) that are at most edits insertions, deletions, substitutions or swaps apart.

    Both sides are spelled out to what deletions leave; equal leftovers make a pair, an unweighted distance of twice
    the edits (a swap counts 2 there) confirms it. How many keys share a leftover has a bound of its own, whatever the
    data's size: letters may be put in at that many places only."""
    a = left.select("a").distinct().select("a", F.explode(deletions(F.col("a"), edits)).alias("k"))
    b = right.select("b").distinct().select("b", F.explode(deletions(F.col("b"), edits)).alias("k"))
    return a.join(b, "k").select("a", "b").distinct().where(F.abs(F.length("a") - F.length("b")) <= edits)


def as_octets(x: str | Column) -> Column:
    """The string with one character for each byte of its UTF-8 form: an edit distance of such strings counts bytes."""
    return F.decode(F.encode(x, "utf-8"), "iso-8859-1")


def plain_distance(a: Column, b: Column, limit: int, octets: bool = False) -> Column:
    """Insertions, deletions and substitutions between two strings, in letters or in bytes; -1 beyond limit."""
    return F.levenshtein(as_octets(a), as_octets(b), limit) if octets else F.levenshtein(a, b, limit)


def one_edit(q: DataFrame, dictionary: DataFrame, octets: bool = False) -> DataFrame:
    """q, cand, word_score: entries whose clean key is 0 or 1 edits from the word's: the edit's weight.

    octets: an edit changes one byte of the keys' UTF-8 form; else one letter, of however many bytes."""
    pairs = near_pairs(q.select(F.col("clean").alias("a")), dictionary.select(F.col("clean").alias("b")), 1)
    n, m = F.length("a"), F.length("b")
    x, y = (as_octets("a"), as_octets("b")) if octets else (F.col("a"), F.col("b"))
    size, one = F.length(x), plain_distance(F.col("a"), F.col("b"), 1, octets)
    # one differing stretch: what the common prefix and suffix leave
    swap = F.when(
        (n == m) & (plain_distance(F.col("a"), F.col("b"), 2, octets) == 2),
        F.exists(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: (F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), x.substr(i + 2, size)) == y)),
    ).otherwise(False)
    score = F.when(F.col("a") == F.col("b"), 0).when((n != m) & (one == 1), 95).when((n == m) & (one == 1), 100).when(swap, 90)
    scored = pairs.withColumn("word_score", score).where("word_score is not null")
    return q.select("q", F.col("clean").alias("a")).join(scored, "a").join(dictionary.select(F.col("word").alias("cand"), F.col("clean").alias("b")), "b").select("q", "cand", "word_score")


def scan(q: DataFrame, dictionary: DataFrame, edits: int) -> DataFrame:
    """q, cand: entries whose soundslike is at most edits from the word's."""
    entries = dictionary.select(F.col("word").alias("cand"), F.col("soundslike").alias("b"))
    own = q.select("q", F.col("soundslike").alias("a"))
    return own.join(near_sounds(own, entries, edits), "a").join(entries, "b").select("q", "cand")


def near_sounds(left: DataFrame, right: DataFrame, edits: int) -> DataFrame:
    """Pairs of soundslikes a of left and b of right that a scan of so many edits compares."""
    if edits == 0:
        return left.select("a").distinct().join(right.select("b").distinct(), F.col("a") == F.col("b"))
    pairs = near_pairs(left, right, edits)
    return pairs.where((F.levenshtein("a", "b", 1) >= 0) | (F.length("a") == F.length("b"))) if edits == 1 else pairs


def sounds_of(left: DataFrame, right: DataFrame, edits: int) -> DataFrame:
    """near_sounds() with a row for each a: a, bs."""
    if edits == 0:
        return near_sounds(left, right, 0).groupBy("a").agg(F.collect_list("b").alias("bs"))
    a = left.select("a").distinct().select("a", F.explode(deletions(F.col("a"), edits)).alias("k"))
    b = right.select("b").distinct().select("b", F.explode(deletions(F.col("b"), edits)).alias("k"))
    met = a.join(b, "k").select("a", "b").where(F.abs(F.length("a") - F.length("b")) <= edits)
    if edits == 1:
        met = met.where((F.levenshtein("a", "b", 1) >= 0) | (F.length("a") == F.length("b")))
    # dealt out once, by a alone
    return met.repartition("a").groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs"))


def are_near(a: Column, b: Column, edits: int) -> Column:
    """Whether near_sounds() has the pair."""
    if edits == 0:
        return a == b
    met = F.when(F.levenshtein(a, b, edits) >= 0, True).when(F.levenshtein(a, b, 2 * edits) >= 0, F.arrays_overlap(deletions(a, edits), deletions(b, edits))).otherwise(False)
    if edits == 1:
        met = F.when((F.levenshtein(a, b, 1) >= 0) | (F.length(a) == F.length(b)), met).otherwise(False)
    return F.when(F.abs(F.length(a) - F.length(b)) <= edits, met).otherwise(False)


def ngrams(q: DataFrame, dictionary: DataFrame, n: int = 3, keep: int = 10) -> DataFrame:
    """q, cand, ngram: entries whose soundslike shares the most parts of up to n characters with the word's: all of a score above 0 that tie with one of the keep best."""
    own, entries = q.select("q", F.col("soundslike").alias("a")), dictionary.select(F.col("word").alias("cand"), F.col("soundslike").alias("b"))
    scored = nearest.best_by_parts(own, entries, n, keep)
    return own.join(scored, "a").join(entries, "b").select("q", "cand", "ngram")


def splits(q: DataFrame, dictionary: DataFrame, chars: tuple[str, ...] = (" ", "-"), language: Language = ENGLISH) -> DataFrame:
    """q, cand: words of four letters and more as two entries of two letters and more, joined by each split character."""
    cut = q.where(F.length("q") >= 4).select("q", F.explode(F.sequence(F.lit(2), F.length("q") - 2)).alias("i"))
    halves = cut.select("q", F.substring("q", F.lit(1), F.col("i")).alias("head"), F.col("q").substr(F.col("i") + 1, F.length("q")).alias("tail"))
    heads = correct(halves, dictionary, "head", language)
    both = correct(heads, dictionary, "tail", language)
    return both.select("q", F.explode(F.transform(F.array(*[F.lit(c) for c in chars]), lambda c: F.concat("head", c, "tail"))).alias("cand")).distinct()


def camel_edits(q: DataFrame, dictionary: DataFrame, language: Language = ENGLISH) -> DataFrame:
    """q, cand, word_score: the word with the case of one letter turned, or moved by one, where all camel-case parts are correct."""
    w, i = F.col("q"), F.col("i")
    at = F.substring(w, i, F.lit(1))
    turned = F.when(at == F.lower(at), F.upper(at)).otherwise(F.lower(at))
    flip = F.concat(F.substring(w, F.lit(1), i - 1), turned, w.substr(i + 1, F.length(w)))
    nxt = F.substring(w, i + 1, F.lit(1))
    moved = F.when((at == F.upper(at)) & (nxt == F.lower(nxt)) & (nxt != ""), F.concat(F.substring(w, F.lit(1), i - 1), F.lower(at), F.upper(nxt), w.substr(i + 2, F.length(w))))
    back = F.when((at == F.lower(at)) & (nxt == F.upper(nxt)) & (nxt != ""), F.concat(F.substring(w, F.lit(1), i - 1), F.upper(at), F.lower(nxt), w.substr(i + 2, F.length(w))))
    rows = q.where(F.length("q") > 1).select("q", F.explode(F.sequence(F.lit(2), F.length("q"))).alias("i"))
    tried = rows.select("q", F.explode(F.array(F.struct(flip.alias("cand"), F.lit(CAMEL).alias("word_score")), F.struct(moved.alias("cand"), F.lit(CAMEL_OFF).alias("word_score")), F.struct(back.alias("cand"), F.lit(CAMEL_OFF).alias("word_score")))).alias("x")).select("q", "x.*").where("cand is not null")
    best = tried.groupBy("q", "cand").agg(F.min("word_score").alias("word_score"))
    parts = best.select("q", "cand", F.explode(split_camel("cand")).alias("part"))
    good = correct(parts.select("part").distinct(), dictionary, "part", language).select("part", F.lit(True).alias("good"))
    whole = parts.join(good, "part", "left").groupBy("q", "cand").agg(F.bool_and(F.coalesce("good", F.lit(False))).alias("all")).where("all")
    return best.join(whole.select("q", "cand"), ["q", "cand"]).select("q", "cand", "word_score")


def table_replacements(q: DataFrame, dictionary: DataFrame, table: DataFrame) -> DataFrame:
    """q, cand: entries that one replacement of a table row (from, to) at one place of the clean word makes."""
    if table.limit(TABLE_ROWS + 1).count() > TABLE_ROWS:
        raise ValueError(f"a replacement table holds at most {TABLE_ROWS} rows: it is sent to all tasks")
    rows = q.select("q", "clean").where("clean <> ''")
    hits = rows.join(F.broadcast(table), F.contains(F.col("clean"), F.col("from")))
    starts = F.filter(F.sequence(F.lit(1), F.length("clean")), lambda i: F.substring("clean", i, F.length("from")) == F.col("from"))
    made = hits.select("q", "clean", "from", "to", F.explode(starts).alias("i"))
    made = made.select("q", F.concat(F.substring("clean", F.lit(1), F.col("i") - 1), F.col("to"), F.col("clean").substr(F.col("i") + F.length("from"), F.length("clean"))).alias("_k"))
    return made.join(dictionary.select(F.col("word").alias("cand"), F.col("clean").alias("_k")), "_k").select("q", "cand").distinct()


def listed_replacements(q: DataFrame, pairs: DataFrame, dictionary: DataFrame | None = None, language: Language = ENGLISH) -> DataFrame:
    """q, cand: corrections that a replacement list (mis, cor) has for the word, by its key; with a dictionary only those whose words it accepts."""
    found = q.select("q", "clean").join(pairs.select(clean("mis").alias("clean"), F.col("cor").alias("cand")), "clean").select("q", "cand").distinct()
    if dictionary is None:
        return found
    halves = F.split("cand", " ", 2)
    cut = found.select("q", "cand", halves[0].alias("head"), F.coalesce(F.get(halves, 1), halves[0]).alias("tail"))
    return correct(correct(cut, dictionary, "head", language), dictionary, "tail", language).select("q", "cand").distinct()


FOUND = ("q", "cand", "given", "kind", "counted")


def _found(rows: DataFrame, kind: str | Column, given: Column | None = None, counted: bool = True) -> DataFrame:
    return rows.select("q", "cand", (F.lit(None) if given is None else given).cast("int").alias("given"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(counted).alias("counted"))


def _once(found: DataFrame) -> DataFrame:
    """A candidate found twice: the given score that is lowest, the counted kind first."""
    best = found.groupBy("q", "cand").agg(F.min(F.struct(F.when(F.col("counted"), 0).otherwise(1).alias("o"), F.col("kind"))).alias("x"), F.min("given").alias("given"))
    return best.select("q", "cand", "given", F.col("x.kind").alias("kind"), (F.col("x.o") == 0).alias("counted"))


def candidates(q: DataFrame, dictionary: DataFrame, mode: Mode, table: DataFrame | None = None, pairs: DataFrame | None = None, camel: bool = False, language: Language = ENGLISH) -> DataFrame:
    """q, cand, given (a score that is not computed), kind, counted: what the searches find that run for all words, but for scans."""
    found = [_found(one_edit(q, dictionary), "edit"), _found(splits(q, dictionary, mode.split_chars, language), "split", F.lit(SPLIT), False)]
    if camel:
        found.append(_found(camel_edits(q, dictionary, language), F.when(F.col("word_score") == CAMEL, "camel").otherwise("camel_off"), F.col("word_score"), False))
    if table is not None and mode.repl_table:
        found.append(_found(table_replacements(q, dictionary, table), "table", F.lit(REPLACED)))
    if pairs is not None:
        found.append(_found(listed_replacements(q, pairs, dictionary, language), "listed"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return _once(every)


def weighted(word: Column, sound: Column, mode: Mode) -> Column:
    return F.floor((mode.word_weight * word + mode.soundslike_weight * sound) / 100).cast("int")


def adjusted(word: Column, sound: Column, mode: Mode) -> Column:
    """Like weighted, but the nearer the word, the less its sound counts."""
    s = mode.soundslike_weight
    w = F.when(word < 100, -(-s // 8)).when(word <= 110, -(-s // 2)).otherwise(s)
    return F.floor((mode.word_weight * word + w * sound) / 100).cast("int")


EDITS = ("split", "camel", "camel_off")


def distances(q: DataFrame, cands: DataFrame, mode: Mode, language: Language = ENGLISH) -> DataFrame:
    """Candidates that may come under their word's threshold, with keys, word_score, sound_score and score."""
    info = cands.join(q.select("q", "stripped", "soundslike", F.col("clean").alias("q_clean")), "q").withColumns({"c_stripped": stripped("cand"), "c_sound": soundslike("cand", language.soundslike), "c_clean": clean("cand")})
    edits = F.col("kind").isin(*EDITS)
    info = _promising(info, edits, mode)
    word = F.when(edits, F.col("given")).otherwise(F.least(F.coalesce("given", F.lit(FAR)), osa_distance("q_clean", "c_clean")))
    sound = F.when(edits, F.col("given")).otherwise(osa_distance("soundslike", "c_sound"))
    told = info.withColumn("word_score", word).withColumn("sound_score", sound)
    return told.withColumn("score", F.when(edits, F.col("given")).otherwise(weighted(F.col("word_score"), F.col("sound_score"), mode)))


def scanned(q: DataFrame, dictionary: DataFrame, pairs: DataFrame, mode: Mode, keyboard: tuple[str, ...] | None = STANDARD_ROWS) -> DataFrame:
    """Entries of near soundslikes (a, bs) that may come under their word's threshold, as of distances(), without those that the mode's limit rules out. A row without cand: the word has others, too far."""
    words = q.select("q", "stripped", F.col("soundslike").alias("a"), F.col("clean").alias("x"))
    entries = dictionary.select(F.col("word").alias("cand"), F.col("soundslike").alias("b"), clean("word").alias("y"), stripped("word").alias("c_stripped")).distinct()
    # other keyboards than rows of keys are left to scored()
    limits = (mode.limit, keyboard, mode.typo_analysis) if not keyboard or isinstance(keyboard, tuple) else ()
    rule = nearest.Rule(mode.word_weight, mode.soundslike_weight, mode.span, mode.skip, *limits)
    near = nearest.near_words(words.withColumn("plain", F.col("stripped") == F.col("x")), pairs, entries.withColumn("plain", F.col("c_stripped") == F.col("y")), rule)
    rows = near.join(words.select("q", "x", "stripped"), "x").join(entries.select("cand", "y", "c_stripped"), "y", "left")
    return rows.select("q", "cand", F.lit("scan").alias("kind"), F.lit(True).alias("counted"), "stripped", "c_stripped", F.col("y").alias("c_clean"), F.col("word").alias("word_score"), F.col("sound").alias("sound_score"), weighted(F.col("word"), F.col("sound"), mode).alias("score"))


TOLD = ("q", "cand", "kind", "counted", "stripped", "c_stripped", "c_clean", "word_score", "sound_score", "score")


def _together(q: DataFrame, dictionary: DataFrame, found: DataFrame, scans: DataFrame, edits: int, mode: Mode, language: Language) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (q, cand) and distances of what scans and other searches found, and scans without what others found, the one table of all pairs that is written. What both find counts as scanned, however far it is."""
    entries = dictionary.select(F.col("word").alias("cand"), F.col("soundslike").alias("b")).distinct()
    also = found.join(q.select("q", F.col("soundslike").alias("a")), "q").join(entries, "cand").where(are_near(F.col("a"), F.col("b"), edits)).select(*FOUND).withColumns({"kind": F.lit("scan"), "counted": F.lit(True)})
    found = stage(_once(found.unionByName(also)), "candidates")
    rest = stage(scans.join(found.select("q", "cand"), ["q", "cand"], "left_anti").select(*TOLD), "scans")
    told = stage(distances(q, found, mode, language).select(*TOLD), "distances").unionByName(rest.where("cand is not null"))
    return found.select("q", "cand").unionByName(rest.select("q", "cand")), told, rest


def _thresholds(told: DataFrame, mode: Mode) -> DataFrame:
    """q, keys (counted words with a key of their own, as far as they matter), third (the last of them: score and key), threshold."""
    keyed = told.where("counted").groupBy("q", "c_clean").agg(F.min("score").alias("score"))
    order = Window.partitionBy("q").orderBy("score", "c_clean")
    best = keyed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mode.skip + 1)
    third = best.groupBy("q").agg(F.max("rank").alias("keys"), F.max(F.struct("score", "c_clean")).alias("third"))
    return third.withColumn("threshold", F.greatest(F.lit(100), F.col("third.score") + mode.span))


def hardness(q: DataFrame, cands: DataFrame, told: DataFrame, mode: Mode) -> DataFrame:
    """q, hard: 3 for words without candidates, 1 where all candidates are near, else 2 where none is worse than the one that sets the threshold, and 0."""
    every = cands.groupBy("q").agg(F.count("*").alias("n"))
    limits = told.select("q").distinct().join(_thresholds(told, mode), "q", "left").withColumn("threshold", F.coalesce("threshold", F.lit(max(100, mode.span))))
    near = told.join(limits, "q").where(F.col("score") <= F.col("threshold") + mode.span)
    worse = F.sum((F.struct("score", "c_clean") >= F.col("third")).cast("int"))
    counts = near.groupBy("q").agg(F.count("*").alias("near"), worse.alias("worse"), F.first("keys").alias("keys"))
    hard = F.when(F.col("n").isNull(), 3).when(F.coalesce("near", F.lit(0)) == F.col("n"), 1).when((F.col("keys") == mode.skip + 1) & (F.col("worse") >= 2), 0).otherwise(2)
    return q.select("q").join(every, "q", "left").join(counts, "q", "left").select("q", hard.alias("hard"))


def scored(told: DataFrame, mode: Mode, keyboard: tuple[str, ...] | None = STANDARD_ROWS) -> DataFrame:
    """q, cand, kind, counted, score, adj of distances(): candidates that stay under their word's thresholds."""
    edits = F.col("kind").isin(*EDITS)
    limits = _thresholds(told, mode).select("q", "threshold")
    # the third counted word with a key of its own sets the threshold
    near = told.join(limits, "q", "left").withColumn("threshold", F.coalesce("threshold", F.lit(max(100, mode.span)))).where(F.col("score") <= F.col("threshold") + mode.span)
    if not mode.typo_analysis:
        return near.withColumn("adj", F.col("score")).where("score <= threshold").select("q", "cand", "kind", "counted", "score", "adj")
    fine = F.when(F.col("kind") == "split", FINE_SPLIT).when(F.col("kind") == "camel", FINE_CAMEL).when(F.col("kind") == "camel_off", FINE_CAMEL_OFF)
    if keyboard:
        typed = typo_distance("c_stripped", "stripped", keyboard)
    else:
        typed = F.col("word_score")
    near = near.withColumn("typo", F.when(edits, F.lit(0)).otherwise(typed))
    typo = F.when(F.col("kind") == "table", F.least("typo", "word_score")).otherwise(F.col("typo"))
    near = near.withColumn("adj", F.coalesce(fine, adjusted(typo, F.col("sound_score"), mode)))
    # what lies above the threshold has to beat the worst one under it; else it only fills up a short list
    worst = F.max(F.when(F.col("score") <= F.col("threshold"), F.col("adj"))).over(Window.partitionBy("q"))
    good = (F.col("score") <= F.col("threshold")) | (F.col("adj") <= F.col("worst"))
    return near.withColumn("worst", worst).select("q", "cand", "kind", "counted", "score", F.when(F.coalesce(good, F.lit(False)), F.col("adj")).otherwise(F.col("adj") + FAR).alias("adj"))


def _promising(info: DataFrame, edits: Column, mode: Mode) -> DataFrame:
    """info without candidates that cannot come under their word's threshold.

    With n plain edits between two strings their weighted distance lies between 45 n (swaps count two) and 100 n. The
    third least upper bound of a word's scores bounds its threshold; what is above it at least goes unseen."""
    w, s = F.levenshtein("q_clean", "c_clean"), F.levenshtein("soundslike", "c_sound")
    given = F.coalesce("given", F.lit(FAR))
    bounds = info.withColumns({"_low": F.when(edits, F.col("given")).otherwise(weighted(F.least(given, 45 * w), 45 * s, mode)), "_high": F.when(edits, F.col("given")).otherwise(weighted(F.least(given, 100 * w), 100 * s, mode))})
    keyed = bounds.where("counted").groupBy("q", "c_clean").agg(F.min("_high").alias("_high"))
    order = Window.partitionBy("q").orderBy("_high")
    third = keyed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mode.skip + 1).groupBy("q").agg(F.max("_high").alias("_third"))
    most = F.greatest(F.lit(100), F.coalesce("_third", F.lit(0)) + mode.span) + mode.span
    return bounds.join(third, "q", "left").where(F.col("_low") <= most).drop("_low", "_high", "_third")


def ranked(q: DataFrame, scores: DataFrame, mode: Mode) -> DataFrame:
    """q, rank, suggestion, adj: in the typed word's case, each string once, the best `limit`."""
    cased = scores.join(q.select("q", "case"), "q").withColumn("suggestion", fix_case("case", "cand"))
    once = cased.groupBy("q", "suggestion").agg(F.min(F.struct("adj", "cand")).alias("x")).select("q", "suggestion", "x.adj", "x.cand")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("adj", "cand", "suggestion"))
    kept = once.withColumn("rank", rank).where((F.col("rank") <= mode.limit) & ((F.col("adj") < FAR) | (F.col("rank") <= mode.least)))
    return kept.select("q", "rank", "suggestion", F.when(F.col("adj") >= FAR, F.col("adj") - FAR).otherwise(F.col("adj")).alias("adj"))


def with_scores(rows: DataFrame, adj: str = "adj") -> DataFrame:
    """rows with distance (a hundredth of the adjusted score) and normalized_score (1 for a perfect match, towards 0)."""
    return rows.withColumns({"distance": F.col(adj) / 100.0, "normalized_score": 100.0 / (F.col(adj) + 100)})


def suggest(words: DataFrame, dictionary: DataFrame, mode: str | Mode = "normal", table: DataFrame | None = None, pairs: DataFrame | None = None, keyboard: tuple[str, ...] | None = STANDARD_ROWS, camel: bool = False, limit: int | None = None, word: str = "word", language: Language = ENGLISH, shared: dict | None = None) -> DataFrame:
    """q, rank, suggestion, adj for each distinct word; words without any suggestion have no rows. limit: a top-k.

    shared: an empty dict, given to calls that differ in their modes only; what several modes compute alike is kept there."""
    m = MODES[mode] if isinstance(mode, str) else mode
    if camel and m.split_chars == (" ", "-"):
        m = replace(m, split_chars=())
    if limit is not None:
        m = replace(m, limit=limit)
    kept = {} if shared is None else shared

    def once(key, make):
        if key not in kept:
            kept[key] = make()
        return kept[key]

    # each is written once: all joins below read it from there
    q = once("queries", lambda: stage(queries(words, word, language), "queries"))
    entries = once("entries", lambda: stage(dictionary.select("word", "clean", "soundslike"), "entries"))
    found = once(("candidates", m.split_chars, m.repl_table), lambda: stage(candidates(q, entries, m, table, pairs, camel, language), "candidates"))
    own, others = q.select(F.col("soundslike").alias("a")), entries.select(F.col("soundslike").alias("b"))
    edits = max(e for e in m.scans if e < 2)
    sounds = once(("sounds", edits), lambda: stage(sounds_of(own, others, edits), "sounds"))
    alike = edits, replace(m, name="", scans=(), ngrams=False)
    cands, told, scans = once(("told", *alike), lambda: _together(q, entries, found, scanned(q, entries, sounds, m, keyboard), edits, m, language))
    open_ = q
    for search, least in m.searches:
        open_ = stage(open_.join(hardness(open_, cands, told, m).where(F.col("hard") >= least).select("q"), "q", "left_semi"), "hard")
        if open_.isEmpty():
            break
        if search == "scan":
            edits = 2
            sounds = stage(sounds_of(open_.select(F.col("soundslike").alias("a")), others, edits), "sounds")
            scans = scanned(open_, entries, sounds, m, keyboard)
        else:
            # without what the searches before found: that is found still
            scans = scans.join(open_.select("q"), "q", "left_semi")
            found = found.unionByName(_found(ngrams(open_, entries, 3, m.ngram_keep), "scan"))
        found = found.join(open_.select("q"), "q", "left_semi")
        cands, fresh, scans = _together(open_, entries, found, scans, edits, m, language)
        told = told.join(open_.select("q"), "q", "left_anti").unionByName(fresh)
    return ranked(q, scored(told, m, keyboard), m)


def camel_parts(words: DataFrame, dictionary: DataFrame, word: str = "word", language: Language = ENGLISH) -> DataFrame:
    """word, prefix, wrong, suffix of camel-case words with exactly one part that no entry accepts."""
    parts = words.select(F.col(word).alias("word")).distinct().withColumn("parts", split_camel("word")).where(F.size("parts") > 1)
    each = parts.select("word", F.posexplode("parts").alias("pos", "part"))
    bad = incorrect(each, dictionary, "part", language).groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("pos", "part")).alias("x")).where("n = 1")
    told = bad.join(parts, "word")
    head, tail = F.slice("parts", F.lit(1), F.col("x.pos")), F.slice("parts", F.col("x.pos") + 2, F.size("parts"))
    return told.select("word", F.array_join(head, "").alias("prefix"), F.col("x.part").alias("wrong"), F.array_join(tail, "").alias("suffix"))


def merged(first: DataFrame, second: DataFrame, limit: int | None = None) -> DataFrame:
    """q, rank, suggestion, adj of two lists as one: each string once, by its best score."""
    once = first.select("q", "suggestion", "adj").unionByName(second.select("q", "suggestion", "adj")).groupBy("q", "suggestion").agg(F.min("adj").alias("adj"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("adj", "suggestion"))
    told = once.withColumn("rank", rank).select("q", "rank", "suggestion", "adj")
    return told if limit is None else told.where(F.col("rank") <= limit)


def suggest_compounds(words: DataFrame, parts: DataFrame, dictionary: DataFrame, **options) -> DataFrame:
    """Suggestions for compounds with one wrong part: parts has word, prefix, wrong, suffix; the ends stay as they are."""
    one = suggest(parts.select(F.col("wrong").alias("word")), dictionary, **options)
    joined = parts.join(one, parts["wrong"] == one["q"]).select("word", "rank", F.concat("prefix", "suggestion", "suffix").alias("suggestion"), "adj")
    return joined.join(words.select("word").distinct(), "word", "left_semi")
