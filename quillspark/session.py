"""The speller: options, dictionaries and all operations on texts and words behind one object."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.distance import STANDARD_ROWS, Keyboard
from quillspark.functions.language import ENGLISH, Language
from quillspark.operators import affix, check, learning, report, suggest
from quillspark.operators.filters import apply_filters, chain, mode_chain
from quillspark.operators.tokenize import tokens
from quillspark.sources import dictionaries
from quillspark.sources.options import Options
from quillspark.storage import stage


@dataclass(frozen=True)
class Speller:
    """All dictionaries are tables (word, aff, clean, soundslike); changes make a new speller."""

    spark: SparkSession
    main: DataFrame
    options: Options
    language: Language = ENGLISH
    personal: DataFrame | None = None
    session: DataFrame | None = None
    pairs: DataFrame | None = None
    table: DataFrame | None = None
    affixes: DataFrame | None = None
    folders: tuple[str, ...] = ("",)

    @staticmethod
    def open(spark: SparkSession, language: Language = ENGLISH, folders: tuple[str, ...] = ("",), affixes: DataFrame | None = None, **settings) -> Speller:
        """A speller of the dictionaries that the options name: master, extra-dicts, wordlists, personal and repl, found in the folders.

        dict-alias holds ``name add one;add two`` items. Replacement lists among the extra dictionaries serve suggestions."""
        options = Options.of({k.replace("_", "-"): v for k, v in settings.items()})
        aliases = dict(x.split(" ", 1) for x in options["dict-alias"])

        def find(name: str) -> tuple[str, DataFrame]:
            return dictionaries.open_dictionary(spark, name, folders, aliases, language)

        kind, main = find(options["master"] or options["lang"])
        if kind != "words":
            raise dictionaries.DictionaryError(f"{options['master']} holds no words")
        found = [find(name) for name in options["extra-dicts"]]
        words, pairs = [t for k, t in found if k == "words"], [t for k, t in found if k == "pairs"]
        if words:
            main = dictionaries.union(main, *words)
        lists = [dictionaries.build(dictionaries.word_list(spark.read.text(path), language, clean_words=True), language) for path in options["wordlists"]]
        own = {}
        for key in ("personal", "repl"):
            if options[key]:
                try:
                    own[key] = find(options[key])[1]
                except dictionaries.DictionaryError:  # there is none yet: it is written when the speller saves
                    if dictionaries._exists(spark, options[key]):
                        raise
        if "repl" in own:
            pairs.append(own["repl"])
        joined = None
        for p in pairs:
            joined = p if joined is None else learning.add_pairs(joined, p)
        session = None if not lists else lists[0] if len(lists) == 1 else dictionaries.union(*lists)
        return Speller(spark, main, options, language, own.get("personal"), session, joined, None, affixes, folders)

    @staticmethod
    def build(spark: SparkSession, main: DataFrame | Iterable[str], language: Language = ENGLISH, **settings) -> Speller:
        if not isinstance(main, DataFrame):
            main = dictionaries.build(spark.createDataFrame([(w, "") for w in main], "word string, aff string"), language)
        options = Options.of({k.replace("_", "-"): v for k, v in settings.items()})
        return Speller(spark, main, options, language)

    def with_options(self, **settings) -> Speller:
        options = self.options
        for k, v in settings.items():
            options = options.set(k.replace("_", "-"), v)
        return replace(self, options=options)

    @property
    def dictionary(self) -> DataFrame:
        """Entries of all dictionaries in use."""
        used = [self.main, *([d for d in (self.personal, self.session) if d is not None] if self.options["use-other-dicts"] else [])]
        return used[0] if len(used) == 1 else dictionaries.union(*used)

    def _frame(self, words: DataFrame | Iterable[str]) -> DataFrame:
        return words if isinstance(words, DataFrame) else self.spark.createDataFrame([(w,) for w in words], "word string")

    def _look(self) -> dict:
        return {"language": self.language, "ignore": self.options["ignore"], "ignore_case": self.options["ignore-case"]}

    def check(self, words: DataFrame | Iterable[str]) -> DataFrame:
        """words with is_correct; compounds and camel-case words as the options say."""
        rows = self._frame(words)
        if self.options["camel-case"]:
            return check.camel_correct(rows, self.dictionary, **self._look())
        told = check.with_verdict(rows, self.dictionary, **self._look())
        if self.affixes is not None:
            # the root that makes a word; of several the first
            made = affix.affix_correct(told.where("not is_correct"), self.dictionary, self.affixes).groupBy("word").agg(F.min("root").alias("root"))
            told = told.join(made, "word", "left").withColumn("is_correct", F.col("is_correct") | F.col("root").isNotNull())
        if self.options["run-together"]:
            joined = check.run_together(told.where("not is_correct"), self.dictionary, limit=self.options["run-together-limit"], least=self.options["run-together-min"], **self._look())
            told = told.join(joined, "word", "left").withColumn("compound", F.col("parts").isNotNull()).withColumn("is_correct", F.col("is_correct") | F.col("compound")).drop("parts")
        return told

    def check_documents(self, docs: DataFrame, text: str = "text", mode: str | None = None) -> DataFrame:
        """Tokens with offsets that are misspelled, after the mode's filters."""
        steps = mode_chain(mode or self.options["mode"])
        steps = steps + chain([f for f in self.options["filter"] if f not in {x.name for x in steps}]) if self.options["mode"] != "none" else steps
        filtered = apply_filters(docs, steps, text, "_filtered").drop(text).withColumnRenamed("_filtered", text)
        found = tokens(filtered, text, self.language)
        bad = self.check(found.select("word").distinct()).where("not is_correct").select("word")
        return found.join(bad, "word", "left_semi")

    def _keyboard(self) -> Keyboard | tuple[str, ...] | None:
        name = self.options["keyboard"]
        if name in ("none", "standard"):
            return None if name == "none" else STANDARD_ROWS
        pairs, keys = dictionaries.read_keyboard(self.spark, name)
        return Keyboard.of([(r["a"], r["b"]) for r in pairs.collect()], keys)  # as many as a keyboard has keys

    def suggest(self, words: DataFrame | Iterable[str], mode: str | None = None, limit: int | None = None) -> DataFrame:
        keyboard = self._keyboard()
        table = self.table if self.options["sug-repl-table"] else None
        pairs = None if self.options["ignore-repl"] else self.pairs
        m = suggest.MODES[mode or self.options["sug-mode"]]
        m = replace(m, split_chars=tuple(self.options["sug-split-char"]), typo_analysis=m.typo_analysis and self.options["sug-typo-analysis"])
        rows, camel = self._frame(words), self.options["camel-case"]
        found = suggest.suggest(rows, self.dictionary, m, table, pairs, keyboard, camel, limit, language=self.language)
        if not camel:
            return found
        # of a word with one wrong part: that part's suggestions inside the word
        parts = stage(suggest.camel_parts(rows, self.dictionary, language=self.language), "parts")
        inner = suggest.suggest_compounds(rows, parts, self.dictionary, mode=m, table=table, pairs=pairs, keyboard=keyboard, limit=limit, language=self.language)
        return suggest.merged(found, inner.withColumnRenamed("word", "q"), limit or m.limit)

    def report(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Protocol lines of all tokens."""
        found = tokens(docs, text, self.language)
        told = found.join(self.check(found.select("word").distinct()), "word")
        wrong = told.where("not is_correct").select("word")
        listed = self.suggest(wrong) if self.options["suggest"] else self.spark.createDataFrame([], "q string, rank int, suggestion string")
        return report.protocol(told, listed, self.options["reverse"], "byte_offset" if self.options["byte-offsets"] else "offset")

    def add_to_session(self, words: DataFrame | Iterable[str]) -> Speller:
        return replace(self, session=learning.add_words(self.session if self.session is not None else self.main.limit(0), self._frame(words), self.language))

    def add_to_personal(self, words: DataFrame | Iterable[str]) -> Speller:
        return replace(self, personal=learning.add_words(self.personal if self.personal is not None else self.main.limit(0), self._frame(words), self.language))

    def clear_session(self) -> Speller:
        return replace(self, session=None)

    def save_all(self, personal_path: str | None = None, repl_path: str | None = None) -> None:
        """Writes the personal list and, unless save-repl is off, the replacements; what the files hold already stays."""
        path = personal_path or self.options["personal"]
        if path:
            dictionaries.save_personal(self.personal if self.personal is not None else self.main.limit(0), path, self.language)
        path = repl_path or self.options["repl"]
        if path and self.pairs is not None and self.options["save-repl"]:
            dictionaries.save_replacements(self.pairs, path, self.language)

    def store_replacements(self, log: DataFrame) -> Speller:
        """Learns from corrections (user, at, mis, cor)."""
        new = learning.learn_pairs(log, self.dictionary, language=self.language)
        return replace(self, pairs=new if self.pairs is None else learning.add_pairs(self.pairs, new))
