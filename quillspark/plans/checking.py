"""Queries on words, dictionaries, filters and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import encoding, language
from quillspark.functions.language import ACCENTED, ENGLISH, PLAIN, sql_accepts, sql_clean, sql_stripped
from quillspark.operators import check, filters, tokenize
from quillspark.sources import dictionaries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def dictionary(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    return dictionaries.frequency_dictionary(documents(spark, sf_dir), least)


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


P = ENGLISH.pattern.replace("'", "''")
#: SQL: all words of documents, and the frequency dictionary.
TOK = f"tok AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '{P}')) AS word FROM documents)"
DICT = f"{TOK}, dict AS (SELECT lower(word) AS word, count(DISTINCT doc_id) AS doc_freq FROM tok WHERE lang = 'en' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)"
KEYED = f"{DICT}, keyed AS (SELECT word, doc_freq, {sql_clean('word')} AS clean FROM dict)"
#: Words that some entry accepts.
ACCEPTED = f"EXISTS (SELECT 1 FROM keyed d WHERE d.clean = {sql_clean('w.word')} AND {sql_accepts('w.word', 'd.word')})"
SOUND = "regexp_replace({x}, '\\.', '', 'g')"


def sql_soundslike(word: str) -> str:
    """The simple soundslike: runs of an equal consonant are one (no back references: letter by letter)."""
    key = sql_clean(word)
    text = f"translate(({key})[1], 'aeiou', '*****') || translate(({key})[2:], 'aeiou', '.....')"
    return f"list_aggregate(list_transform(range(1, len({text}) + 1), lambda i: CASE WHEN ({text})[i] = '.' OR i > 1 AND ({text})[i] = ({text})[i - 1] THEN '' ELSE ({text})[i] END), 'string_agg', '')"


@query(f"WITH {TOK} SELECT d.doc_id, count(t.word) AS n_tokens, count(DISTINCT lower(t.word)) AS n_words FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY 1")
def tokens_per_doc(spark, sf_dir):
    words = F.coalesce(tokenize.words("text"), F.array().cast("array<string>"))
    each = documents(spark, sf_dir).select("doc_id", words.alias("w"))
    return each.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct(F.transform("w", F.lower))).cast("long").alias("n_words"))


@query(
    f"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '[^\\p{{L}}]*?{P}') AS g FROM documents),
    e AS (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM m),
    s AS (SELECT doc_id, i, regexp_extract(x, '{P}$') AS word, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(strlen(x)) OVER (PARTITION BY doc_id ORDER BY i) AS bytes FROM e)
    SELECT doc_id, CAST(i - 1 AS INT) AS pos, CAST(upto - length(word) AS INT) AS "offset", CAST(length(word) AS INT) AS len, CAST(bytes - strlen(word) AS INT) AS byte_offset, word FROM s"""
)
def token_offsets(spark, sf_dir):
    return tokenize.tokens(documents(spark, sf_dir).select("doc_id", "text"))


@query(f"WITH {TOK} SELECT lower(word) AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY 1")
def word_frequency(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", F.explode(F.transform(tokenize.words("text"), F.lower)).alias("word"))
    # a document's counts first: the second step then adds and counts rows
    return words.groupBy("word", "doc_id").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query("WITH w AS (SELECT page_id, unnest(regexp_extract_all(html, '" + P + "')) AS word FROM pages) SELECT p.page_id, count(w.word) AS n_tokens FROM pages p LEFT JOIN w USING (page_id) GROUP BY 1")
def page_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.size(tokenize.words("html")), F.lit(0)).cast("long").alias("n_tokens"))


@query(f"WITH {KEYED} SELECT word, '' AS aff, clean, {sql_soundslike('word')} AS soundslike, doc_freq FROM keyed")
def dict_build(spark, sf_dir):
    return dictionary(spark, sf_dir).select("word", "aff", "clean", "soundslike", "doc_freq")


@query(f"WITH {TOK}, d AS (SELECT DISTINCT word FROM tok), k AS (SELECT word, {sql_clean('word')} AS clean FROM d) SELECT word, clean, count(*) OVER (PARTITION BY clean) > 1 AS is_duplicate FROM k")
def dict_dedup_flags(spark, sf_dir):
    words = tokenize.explode_words(documents(spark, sf_dir).select("text")).distinct()
    return dictionaries.duplicates(dictionaries.build(words.select("word", F.lit("").alias("aff")))).select("word", "clean", "is_duplicate")


@query(
    f"""WITH {TOK}, c AS (SELECT word, CASE WHEN word = lower(word) THEN 'AllLower' WHEN word = upper(word) THEN 'AllUpper'
    WHEN word[1] = upper(word[1]) AND word[2:] = lower(word[2:]) THEN 'FirstUpper' ELSE 'Other' END AS "case" FROM tok)
    SELECT "case", count(*) AS n, count(DISTINCT word) AS n_words FROM c GROUP BY 1"""
)
def case_pattern_hist(spark, sf_dir):
    words = tokenize.explode_words(documents(spark, sf_dir).select("text")).groupBy("word").agg(F.count("*").alias("n"))
    return words.groupBy(language.case_pattern("word").alias("case")).agg(F.sum("n").alias("n"), F.count("*").alias("n_words"))


@query(
    f"""WITH {TOK}, d AS (SELECT DISTINCT word FROM tok)
    SELECT word = translate(word, '{ACCENTED}', '{PLAIN}') AS all_plain, word = {sql_clean('word')} AS all_clean, count(*) AS n FROM d GROUP BY 1, 2"""
)
def word_info_bits(spark, sf_dir):
    words = tokenize.explode_words(documents(spark, sf_dir).select("text")).distinct().select(language.word_info("word").alias("i"))
    return words.groupBy("i.all_plain", "i.all_clean").agg(F.count("*").alias("n"))


@query(f"WITH {TOK}, d AS (SELECT DISTINCT word FROM tok), k AS (SELECT {sql_clean('word')} AS clean, word FROM d) SELECT clean, count(*) AS n, min(word) AS first_word, max(word) AS last_word FROM k GROUP BY 1 HAVING count(*) > 1")
def clean_key_collisions(spark, sf_dir):
    words = tokenize.explode_words(documents(spark, sf_dir).select("text")).distinct()
    return words.groupBy(language.clean("word").alias("clean")).agg(F.count("*").alias("n"), F.min("word").alias("first_word"), F.max("word").alias("last_word")).where("n > 1")


@query(f"WITH {TOK} SELECT DISTINCT word, {sql_stripped('word')} AS stripped, translate(word, '{ACCENTED}', '{PLAIN}') AS plain FROM tok")
def stripped_key(spark, sf_dir):
    words = tokenize.explode_words(documents(spark, sf_dir).select("text")).distinct()
    return words.select("word", language.stripped("word").alias("stripped"), language.de_accent("word").alias("plain"))


@query(f"WITH {TOK}, d AS (SELECT DISTINCT lower(word) AS word FROM tok) SELECT word, {sql_soundslike('word')} AS soundslike FROM d")
def soundslike_simple(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(F.transform(tokenize.words("text"), F.lower)).alias("word")).distinct()
    return words.select("word", language.soundslike("word").alias("soundslike"))


@query(f"WITH {KEYED} SELECT {sql_soundslike('word')} AS soundslike, count(*) AS n, min(word) AS first_word FROM keyed GROUP BY 1")
def soundslike_groups(spark, sf_dir):
    return dictionary(spark, sf_dir).groupBy("soundslike").agg(F.count("*").alias("n"), F.min("word").alias("first_word"))


@query("SELECT p_partkey, CASE WHEN p_name = '' THEN '' ELSE upper(p_name[1]) || p_name[2:] END AS titled, upper(p_name) AS uppered FROM part")
def fix_case_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", language.fix_case(F.lit("FirstUpper"), "p_name").alias("titled"), language.fix_case(F.lit("AllUpper"), "p_name").alias("uppered"))


@query("SELECT c_custkey, regexp_full_match(c_name, '" + P + "') AS name_valid, regexp_full_match(c_mktsegment, '" + P + "') AS segment_valid FROM customer")
def valid_word_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", language.is_valid("c_name").alias("name_valid"), language.is_valid("c_mktsegment").alias("segment_valid"))


@query("SELECT p_partkey, regexp_extract(p_type, '(\\p{L}.*\\p{L}|\\p{L})', 1) AS cleaned FROM part")
def clean_edges(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", dictionaries.strip_edges("p_type").alias("cleaned"))


@query("SELECT p_partkey, regexp_extract_all(array_to_string(list_transform(string_split(p_type, ' '), lambda x: CASE WHEN x = '' THEN '' ELSE x[1] || lower(x[2:]) END), ''), '[A-Z]?[a-z]+') AS parts FROM part")
def camel_split(spark, sf_dir):
    joined = F.array_join(F.transform(F.split("p_type", " "), lambda x: F.when(x == "", "").otherwise(F.concat(F.substring(x, 1, 1), F.lower(x.substr(F.lit(2), F.length(x)))))), "")
    return table(spark, sf_dir, "part").select("p_partkey", language.split_camel(joined).alias("parts"))


@query("SELECT doc_id, nfc_normalize(text) AS text, strlen(text) AS n_bytes FROM documents")
def unicode_nfc(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", encoding.normalize("text", "nfc").alias("text"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, text FROM documents")
def encoding_round_trip(spark, sf_dir):
    """UTF-8 to UTF-16 and back."""
    there = encoding.convert(F.encode("text", "utf-8"), "utf-8", "utf-16le")
    back = encoding.convert(there, "utf-16le", "utf-8")
    return documents(spark, sf_dir).select("doc_id", F.octet_length(back).cast("long").alias("n_bytes"), encoding.repaired(back).alias("text"))


@query(f"WITH {KEYED}, w AS (SELECT word, count(*) AS n FROM tok WHERE lang = 'en' GROUP BY 1) SELECT word, n FROM w WHERE length(word) > 1 AND NOT {ACCEPTED}")
def misspelled_words(spark, sf_dir):
    return check.misspelled_counts(documents(spark, sf_dir).where("lang = 'en'"), dictionary(spark, sf_dir))


@query(
    f"""WITH {KEYED}, w AS (SELECT lang, word, count(*) AS n FROM tok GROUP BY 1, 2),
    v AS (SELECT *, length(word) > 1 AND NOT {ACCEPTED} AS bad FROM w)
    SELECT lang, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN bad THEN n ELSE 0 END) AS BIGINT) AS n_bad, round(sum(CASE WHEN bad THEN n ELSE 0 END) / sum(n), 6) AS rate FROM v GROUP BY 1"""
)
def misspelling_rate_by_lang(spark, sf_dir):
    words = tokenize.explode_words(documents(spark, sf_dir).select("lang", "text")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    told = check.with_verdict(words, dictionary(spark, sf_dir))
    bad = F.sum(F.when(~F.col("is_correct"), F.col("n")).otherwise(0))
    return told.groupBy("lang").agg(F.sum("n").alias("n_tokens"), bad.alias("n_bad"), F.round(bad / F.sum("n"), 6).alias("rate"))


@query(
    f"""WITH {KEYED}, w AS (SELECT t.word, l.quality, count(*) AS n FROM tok t JOIN labels l USING (doc_id) GROUP BY 1, 2),
    v AS (SELECT *, length(word) > 1 AND NOT {ACCEPTED} AS bad FROM w)
    SELECT quality, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN bad THEN n ELSE 0 END) AS BIGINT) AS n_bad FROM v GROUP BY 1"""
)
def misspelling_rate_by_quality(spark, sf_dir):
    labelled = documents(spark, sf_dir).select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    words = tokenize.explode_words(labelled.select("quality", "text")).groupBy("quality", "word").agg(F.count("*").alias("n"))
    told = check.with_verdict(words, dictionary(spark, sf_dir))
    return told.groupBy("quality").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(~F.col("is_correct"), F.col("n")).otherwise(0)).alias("n_bad"))


@query(f"WITH {KEYED}, w AS (SELECT DISTINCT word FROM tok) SELECT word, length(word) <= 1 OR {ACCEPTED} AS is_correct FROM w")
def check_case_sensitive(spark, sf_dir):
    words = tokenize.explode_words(documents(spark, sf_dir).select("text")).distinct()
    return check.with_verdict(words, dictionary(spark, sf_dir))


@query(
    f"""WITH {KEYED}, w AS (SELECT DISTINCT word FROM tok)
    SELECT word, length(word) <= 1 OR EXISTS (SELECT 1 FROM keyed d WHERE d.clean = {sql_clean('w.word')} AND upper(w.word) = upper(d.word)) AS is_correct FROM w"""
)
def check_case_insensitive(spark, sf_dir):
    words = tokenize.explode_words(documents(spark, sf_dir).select("text")).distinct()
    return check.with_verdict(words, dictionary(spark, sf_dir), ignore_case=True)


@query(f"WITH {KEYED}, w AS (SELECT DISTINCT word FROM tok) SELECT word FROM w WHERE length(word) > 3 AND NOT {ACCEPTED}")
def ignore_short_words(spark, sf_dir):
    words = tokenize.explode_words(documents(spark, sf_dir).select("text")).distinct()
    return check.incorrect(words, dictionary(spark, sf_dir), ignore=3)


@query(f"WITH {KEYED} SELECT t.word, d.word AS entry FROM (SELECT DISTINCT word FROM tok) t JOIN keyed d ON d.clean = {sql_clean('t.word')}")
def clean_lookup(spark, sf_dir):
    words = tokenize.explode_words(documents(spark, sf_dir).select("text")).distinct()
    return check.lookup_clean(words, dictionary(spark, sf_dir))


@query(
    f"""WITH {KEYED}, p AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{P}'))) AS word FROM benchmark),
    u AS (SELECT word, {sql_clean('word')} AS clean FROM (SELECT word FROM dict UNION SELECT word FROM p)), w AS (SELECT DISTINCT word FROM tok)
    SELECT word FROM w WHERE length(word) > 1 AND NOT EXISTS (SELECT 1 FROM u d WHERE d.clean = {sql_clean('w.word')} AND {sql_accepts('w.word', 'd.word')})"""
)
def personal_dict_union(spark, sf_dir):
    """Words that neither the frequency dictionary nor a personal list (all words of benchmark) accepts."""
    own = table(spark, sf_dir, "benchmark").select(F.explode(F.transform(tokenize.words("text"), F.lower)).alias("word")).distinct()
    both = dictionaries.union(dictionary(spark, sf_dir), dictionaries.build(own.select("word", F.lit("").alias("aff"))))
    words = tokenize.explode_words(documents(spark, sf_dir).select("text")).distinct()
    return check.incorrect(words, both)


@query(
    f"""WITH {TOK}, d AS (SELECT lang, lower(word) AS word FROM tok GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3)
    SELECT word, CAST(min(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END) AS INT) AS dict_priority FROM d WHERE lang IN ('en', 'de', 'fr') GROUP BY 1"""
)
def multi_dict_union(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return dictionaries.union(*[dictionaries.frequency_dictionary(docs, 3, lang) for lang in ("en", "de", "fr")]).select("word", "dict_priority")


#: SQL: what becomes blank, line ends aside.
BLANK = "regexp_replace({x}, '[^\\n]', ' ', 'g')"


def _segments(column: str, pattern: str, rule: str) -> str:
    """SQL: column cut by a pattern into segments x, each replaced by the rule, and put together."""
    return f"array_to_string(list_transform(regexp_extract_all({column}, '{pattern}'), lambda x: {rule}), '')"


@query("SELECT doc_id, " + _segments("text", filters.RUNS, f"CASE WHEN regexp_matches(x, '{filters.URL_SQL}') THEN {BLANK.format(x='x')} ELSE x END") + " AS filtered FROM documents")
def url_filter(spark, sf_dir):
    return filters.apply_filters(documents(spark, sf_dir).select("doc_id", "text"), ["url"]).select("doc_id", "filtered")


@query("SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^[^\\>\\|]{0,10}[\\>\\|]') THEN repeat(' ', length(x)) ELSE x END), chr(10)) AS filtered FROM conversations")
def email_quote_filter(spark, sf_dir):
    return filters.apply_filters(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["email"]).select("conv_id", "turn", "filtered")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n]+', ' ', 'g'), ' ') AS text FROM pages")
def html_strip_tags(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " "), r"[ \t\n]+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(bare).alias("text"))


_HTML = _segments("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&#?[A-Za-z0-9]*;?|[^<&]+|.", f"CASE WHEN x[1] IN ('<', '&') THEN {BLANK.format(x='x')} ELSE x END")


@query(f"WITH f AS (SELECT page_id, {_HTML} AS filtered FROM pages) SELECT page_id, filtered, CAST(len(regexp_extract_all(filtered, '{P}')) AS INT) AS n_tokens FROM f")
def html_filter(spark, sf_dir):
    done = filters.apply_filters(table(spark, sf_dir, "pages"), ["html"], "html")
    return done.select("page_id", "filtered", F.size(tokenize.words("filtered")).alias("n_tokens"))


_REFERENCES = _segments("html", r"&#[0-9]*;?|&[A-Za-z][\w.-]*;?|[^&]+|&", "CASE WHEN starts_with(x, '&#') THEN chr(CAST('0' || regexp_extract(x, '[0-9]+') AS INT)) WHEN regexp_matches(x, '^&[A-Za-z]') THEN '?' ELSE x END")


@query(f"WITH p AS (SELECT page_id, html || '&#65;&eacute;&#233' AS html FROM pages) SELECT page_id, {_REFERENCES} AS decoded, CAST(length(html) AS INT) AS source_chars FROM p")
def html_decoder(spark, sf_dir):
    """Pages, each with three more character references at its end."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit("&#65;&eacute;&#233")).alias("html"))
    return filters.decoded(pages, "html").select("page_id", "decoded", F.aggregate("widths", F.lit(0), lambda a, x: a + x).alias("source_chars"))


_CONTEXT = _segments(
    "html",
    r"""(?s)"[^"]*"?|//[^\n]*|/\*.*?\*/|[^"/]+|/""",
    f"""CASE WHEN x[1] = '"' THEN ' ' || CASE WHEN length(x) > 1 AND right(x, 1) = '"' THEN x[2:-2] || ' ' ELSE x[2:] END WHEN starts_with(x, '//') THEN '  ' || x[3:]
    WHEN starts_with(x, '/*') THEN '  ' || x[3:-3] || '  ' ELSE {BLANK.format(x='x')} END""",
)


@query(f"SELECT page_id, {_CONTEXT} AS filtered FROM pages")
def context_filter(spark, sf_dir):
    return filters.apply_filters(table(spark, sf_dir, "pages").select("page_id", "html"), ["context"], "html").select("page_id", "filtered")


# Whole documents inside markup of each kind: what is written, and what the filter leaves of it. None: the document's text.
TEX = (
    ("\\documentclass[a4]{book}\n", " " * 24 + "\n"),
    ("\\section{", " " * 9),
    (None, None),
    ("\n} \\textbf{bold} ", "\n  " + " " * 8 + "bold  "),
    ("\\cite[see]{key} ", " " * 6 + "see" + " " * 7),
    ("\\newcommand{\\x}[2][opt]{body} ", " " * 19 + "opt" + "  " + "body  "),
    ("\\begin{center}mid\\end{center} ", " " * 14 + "mid" + " " * 13),
    ("5\\% kept % gone", "5   kept" + " " * 7),
)
TEXINFO = (
    ("\\input texinfo\n", " " * 14 + "\n"),
    ("@chapter ", " " * 9),
    (None, None),
    ("\n@emph{kept} @code{gone} ", "\n     {kept}      {    } "),
    ("\n@example\ngone here\n@end example\n", "\n        \n         \n            \n"),
    ("@table @code\n@item gone\nkept\n@end table\n@c a note", " " * 12 + "\n" + " " * 10 + "\nkept\n" + " " * 10 + "\n" + " " * 9),
)
NROFF = (
    (".TH NAME 1\n", "    NAME 1\n"),
    (".ds XX kept\n", "       kept\n"),
    (None, None),
    ("\n\\fBbold\\fR and \\(co \\*x end\n", "\n   bold    and        x end\n"),
    (".\\\" note", "    note"),
)
MARKDOWN = (
    ("Head\n====\n\n", "Head\n    \n\n"),
    ("> ", "  "),
    (None, None),
    ("\n\n[link](http://a.b/c) and `code` and ``co`de``\n\n", "\n\n[link]" + " " * 14 + " and " + " " * 6 + " and " + " " * 9 + "\n\n"),
    ("```\nfenced\n```\n", "   \n      \n   \n"),
    ("[ref]: http://a.b 'title'\n\n", " " * 18 + "'title'\n\n"),
    ("- item <b>bold</b> <!-- note -->", "  item    bold    " + " " * 14),
)


def _in_markup(docs: DataFrame, parts) -> DataFrame:
    return docs.select("doc_id", F.concat(*[F.col("text") if source is None else F.lit(source) for source, _ in parts]).alias("text"))


def _left(parts, text: str) -> str:
    """SQL: what is left of documents in markup, if of a text alone this is left."""
    told = " || ".join(text if left is None else "'" + left.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for _, left in parts)
    return f"SELECT doc_id, {told} AS filtered FROM documents"


_LINES = "array_to_string(list_transform(string_split(text, chr(10)), lambda x: {rule}), chr(10))"


@query(_left(TEX, _LINES.format(rule="CASE WHEN contains(x, '%') THEN left(x, strpos(x, '%') - 1) || repeat(' ', length(x) - strpos(x, '%') + 1) ELSE x END")))
def tex_filter(spark, sf_dir):
    return filters.apply_filters(_in_markup(documents(spark, sf_dir), TEX), ["tex"]).select("doc_id", "filtered")


@query(_left(TEXINFO, _segments("text", "@[A-Za-z]+|@[^A-Za-z]|[^@]+|@", f"CASE WHEN length(x) > 1 AND x[1] = '@' THEN {BLANK.format(x='x')} ELSE x END")))
def texinfo_filter(spark, sf_dir):
    return filters.apply_filters(_in_markup(documents(spark, sf_dir), TEXINFO), ["texinfo"]).select("doc_id", "filtered")


@query(_left(NROFF, "text"))
def nroff_filter(spark, sf_dir):
    return filters.apply_filters(_in_markup(documents(spark, sf_dir), NROFF), ["nroff"]).select("doc_id", "filtered")


@query(_left(MARKDOWN, _segments("text", "&#?[A-Za-z0-9]*;?|[^&]+", f"CASE WHEN x[1] = '&' THEN {BLANK.format(x='x')} ELSE x END")))
def markdown_filter(spark, sf_dir):
    return filters.apply_filters(_in_markup(documents(spark, sf_dir), MARKDOWN), ["markdown", "sgml"]).select("doc_id", "filtered")


@query(
    f"""WITH {KEYED}, w AS (SELECT role, unnest(regexp_extract_all(text, '{P}')) AS word FROM conversations)
    SELECT role, word, count(*) AS n FROM w WHERE length(word) > 1 AND NOT {ACCEPTED} GROUP BY 1, 2"""
)
def conversation_misspellings(spark, sf_dir):
    words = tokenize.explode_words(table(spark, sf_dir, "conversations").select("role", "text")).groupBy("role", "word").agg(F.count("*").alias("n"))
    return check.incorrect(words, dictionary(spark, sf_dir))


@query(
    f"""WITH c AS (SELECT chr(CAST(i AS INT)) AS c FROM range(97, 592) r(i)), w AS (SELECT c AS word FROM c WHERE regexp_matches(c, '^\\p{{L}}$') UNION ALL SELECT 'b' || c FROM c WHERE regexp_matches(c, '^\\p{{L}}$')),
    s AS (SELECT DISTINCT {sql_soundslike('word')} AS s FROM w), l AS (SELECT DISTINCT unnest(string_split(s, '')) AS letter FROM s) SELECT letter FROM l WHERE letter <> ''"""
)
def soundslike_alphabet(spark, sf_dir):
    """Letters that soundslikes of words in Latin letters may hold."""
    return language.soundslike_alphabet(spark)


@query(f"WITH {KEYED} SELECT count(*) AS n FROM keyed w WHERE length(word) > 1 AND NOT {ACCEPTED}")
def dump_and_recheck(spark, sf_dir):
    """Entries that their own dictionary rejects: none."""
    d = dictionary(spark, sf_dir)
    return check.incorrect(d.select("word"), d).agg(F.count("*").alias("n"))


@query(f"WITH {DICT}, b AS (SELECT word, lag(word) OVER (PARTITION BY word[1:2] ORDER BY word) AS b FROM dict), c AS (SELECT word, CASE WHEN b IS NULL THEN 0 ELSE list_max(list_concat([0], list_filter(range(1, least(length(word), length(b)) + 1), lambda i: word[1:i] = b[1:i]))) END AS prefix FROM b) SELECT word, CAST(prefix AS INT) AS prefix, word[prefix + 1:] AS rest FROM c")
def front_coding(spark, sf_dir):
    return dictionaries.front_coded(dictionary(spark, sf_dir)).select("word", "prefix", "rest")
