"""Filters, dictionaries, checks, suggestions, affixes and reports on small fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import affix, check, filters, learning, report, suggest, tokenize
from quillspark.session import Speller
from quillspark.sources import dictionaries

WORDS = "the a an and in on of to for with this that these those there their hear heard here where were wear word words world work works worked working swim swims swimmer swimming summer simmer receive received receiver believe relief letter letters better butter bitter number numbers other mother father brother sister house houses mouse horse hand hands head heads heart apple apples table tables chair paper pencil water river ocean Paris McDonald café naïve don't can't".split()


@pytest.fixture(scope="module")
def words(spark):
    return dictionaries.build(spark.createDataFrame([(w, "") for w in WORDS], "word string, aff string")).cache()


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "word string")


CASES = [
    ("url", "see http://a.b/c now", "see              now"),
    ("url", "an me@x.org b", "an          b"),
    ("url", "a me@x.org b", " " * 11 + "b"),
    ("url", "x a.b.. c.d/", "x a.b.. c.d/"),
    ("url", "no. dots... here", "no. dots... here"),
    ("url", "www.x.org", "         "),
    ("email", "> quoted\nmine", "        \nmine"),
    ("html", "<p>a<b x='>'>b</b></p>", "   a         b        "),
    ("html", "a<script>var x</script>b", "a" + " " * 22 + "b"),
    ("html", '<img alt="a cat" src="x">', " " * 10 + "a cat" + " " * 10),
    ("html", "a&amp;b<!-- c -->d", "a     b          d"),
    ("html", "<img hidden alt='x'>y<!--->z A & B", " " * 20 + "y" + " " * 6 + "z A   B"),
    ("html", "<script/>a</script x>b<style>c<style>d</style>e</style>f", "         a           b" + " " * 33 + "f"),
    ("tex", "a \\textbf{b} % c\nd", "a b d"),
    ("tex", "\\cite{a{b}c} \\cite[d]{e} \\foo % f\n{g} \\% h \\\\% i", "b d g h"),
    ("tex", "\\label{sec:x} see", "              see"),
    ("texinfo", "use @code{x1} now", "use now"),
    ("nroff", ".B lost kept\n.SH Don't go on\n", "        kept\n    Don      on\n"),
    ("nroff", "\\- \\*x \\n(ab \\s+12 \\[co x] \\\" c\n.if t .SH x\n.ds\nAB c", " - " + "  x " + " " * 6 + " " * 6 + " " * 8 + "   c\n" + " " * 10 + "x\n   \n   c"),
    ("nroff", ".TH name\ntext \\fBbold\\fR end", "    name\ntext    bold    end"),
    ("markdown", "a `code` b", "a        b"),
    ("markdown", "[text](http://x.y) z", "text z"),
    ("markdown", "```\nx\n```\ny", "   \n \n   \ny"),
    ("markdown", "    code\n\ntext", "        \n\ntext"),
    ("context", 'x = "say"; // done', "     say      done"),
]


@pytest.mark.parametrize(("name", "text", "expected"), CASES)
def test_filter(name, text, expected):
    import re

    out = filters.REGISTRY[name](text)
    assert len(out) == len(text)
    if name in ("texinfo", "markdown", "tex"):  # brackets may stay: what counts is which words do
        assert re.findall(r"\w+", out) == re.findall(r"\w+", expected)
    else:
        assert out == expected


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(filters.REGISTRY)), st.text("ab <>/\\\"'`~#*_[](){}@.%&;:!-=\n\t>|1", max_size=60))
def test_filters_only_blank(name, text):
    out = filters.REGISTRY[name](text)
    assert len(out) == len(text)
    assert all(b in (a, " ") for a, b in zip(text, out, strict=True))


def test_decoder():
    assert filters.decode_references("a&#65;b&eacute;c") == ("aAb?c", [1, 5, 1, 8, 1])
    assert filters.decode_references("&#x41;")[0] == "\0x41;"


def test_modes_and_chain():
    assert [f.name for f in filters.mode_chain("markdown")] == ["markdown", "sgml", "url"]
    assert filters.detect_mode("x.cpp") == "ccpp" and filters.detect_mode("x", "#!/usr/bin/perl\n") == "perl" and filters.detect_mode("a.md") == "markdown"
    assert filters.chain([("context", {"delimiters": (("#", "\0"),)})])[0]("a # b\nc") == "    b\n "


def test_expressions_equal_functions(spark):
    texts = ["see http://a.b/c now", "me@x.org", "x.y.z q", '"a//b" c', "> q\nr | s", "1234567890123 > x", "", "a.b", "a.b/", "@x", "x@", "a/b.c"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in rows.select(filters.url_expression("text")).collect()] == [filters.url(t) for t in texts]
    assert [r[0] for r in rows.select(filters.email_expression("text")).collect()] == [filters.email(t) for t in texts]


def test_tokens(spark):
    rows = spark.createDataFrame([(1, "Don't stop, été!"), (2, ""), (3, None)], "doc_id long, text string")
    got = [tuple(r) for r in tokenize.tokens(rows).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, 0, 5, 0, "Don't"), (1, 1, 6, 4, 6, "stop"), (1, 2, 12, 3, 12, "été")]


def test_dictionary_files(spark, words, tmp_path):
    path = str(tmp_path / "d")
    dictionaries.save(words, path)
    assert {r.word for r in dictionaries.load(spark, path).collect()} == set(WORDS)
    from quillspark.functions.language import Language

    with pytest.raises(dictionaries.DictionaryError):
        dictionaries.load(spark, path, Language(name="de"))
    personal = str(tmp_path / "p")
    dictionaries.save_personal(words.where("word in ('the', 'café')"), personal)
    assert {r.word for r in dictionaries.read_personal(spark, personal).collect()} == {"the", "café"}
    (tmp_path / "r.prepl").write_text("personal_repl-1.1 en 0\nteh the\nalot a lot\n\n")
    assert {tuple(r) for r in dictionaries.read_replacements(spark, str(tmp_path / "r.prepl")).collect()} == {("teh", "the"), ("alot", "a lot")}
    (tmp_path / "rep").write_text("REP 2\nREP f ph\nREP a a\n")
    assert [tuple(r) for r in dictionaries.read_pairs(spark, str(tmp_path / "rep")).collect()] == [("f", "ph")]
    (tmp_path / "kbd").write_text("# keys\nqw\nwe\nkey aA\n")
    pairs, keys = dictionaries.read_keyboard(spark, str(tmp_path / "kbd"))
    assert {tuple(r) for r in pairs.collect()} == {("q", "w"), ("w", "e")} and keys == ["aA"]
    (tmp_path / "w.txt").write_text("good/AB\nbad1\n\nfine\n")
    lines = spark.read.text(str(tmp_path / "w.txt"))
    assert {tuple(r) for r in dictionaries.word_list(lines).collect()} == {("good", "AB"), ("fine", "")}
    assert dictionaries.unescape(dictionaries.escape("a#b\\c\nd")) == "a#b\\c\nd"


def test_catalogue(spark):
    names = ["en.multi", "en_US.multi", "en_GB-ise-70.multi", "de-80.multi", "readme.txt"]
    cat = dictionaries.catalogue(spark, names)
    assert cat.count() == 4
    assert dictionaries.select(cat, "en_US").first()["name"] == "en_US"
    assert dictionaries.select(cat, "en_GB", variety="ise").first()["name"] == "en_GB-ise-70"
    assert dictionaries.select(cat, "de").first()["size"] == "80"


def test_merged_flags(spark):
    rows = spark.createDataFrame([("x", "A"), ("x", "BA"), ("y", "")], "word string, aff string")
    assert {(r.word, r.aff) for r in dictionaries.build(rows).collect()} == {("x", "AB"), ("y", "")}
    both = spark.createDataFrame([("The", "A"), ("the", "B"), ("Rome", "")], "word string, aff string")
    assert {tuple(r) for r in affix.combine(both).collect()} == {("the", "AB"), ("Rome", "")}


def test_check(spark, words):
    told = {r.word: r.is_correct for r in check.with_verdict(frame(spark, ["the", "The", "THE", "tHe", "teh", "x", "paris", "PARIS", "mcdonald", "Café", "cafe", None]), words).collect()}
    assert told == {"the": True, "The": True, "THE": True, "tHe": False, "teh": False, "x": True, "paris": False, "PARIS": True, "mcdonald": False, "Café": True, "cafe": False, None: True}


def test_compounds(spark, words):
    got = {r.word: list(r.parts) for r in check.run_together(frame(spark, ["handword", "theirthere", "applexyz"]), words).collect()}
    assert got == {"handword": ["hand", "word"], "theirthere": ["their", "there"]}
    three = check.run_together(frame(spark, ["handheadword"]), words, limit=3)
    assert [list(r.parts) for r in three.collect()] == [["hand", "head", "word"]]
    camel = {r.word: (r.is_correct, r.n_wrong, r.first_wrong) for r in check.camel_correct(frame(spark, ["handWord", "handWrd", "the"]), words).collect()}
    assert camel == {"handWord": (True, 0, None), "handWrd": (False, 1, "Wrd"), "the": (True, 0, None)}


@pytest.mark.parametrize("mode", sorted(suggest.MODES))
def test_suggest(spark, words, mode):
    rows = suggest.suggest(frame(spark, ["swimer", "Recieve", "wrold", "handword", "TEH"]), words, mode).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.q, []).append(r.suggestion)
    assert "swimmer" in got["swimer"][:3]
    assert got["Recieve"][0] == "Receive"
    assert "world" in got["wrold"][:2]
    assert {"hand word", "hand-word"} <= set(got["handword"])
    assert "THE" in got["TEH"]


def test_one_edit_is_complete(spark, words):
    """Each entry one edit away is found, with its weight."""
    from quillspark.functions.distance import osa

    typed = ["hnad", "hando", "han", "hbnd", "words", "hear"]
    got = {(r.q, r.cand): r.word_score for r in suggest.one_edit(suggest.queries(frame(spark, typed)), words).collect()}
    plain = {w: r for w, r in ((r.word, r.clean) for r in words.collect())}
    for q in typed:
        for w, c in plain.items():
            d = osa(q, c)
            if d <= 100:
                assert got[q, w] == d


def test_replacements(spark, words):
    table = spark.createDataFrame([("f", "ph"), ("uo", "ou")], "`from` string, `to` string")
    q = suggest.queries(frame(spark, ["huose", "xyz"]))
    assert {tuple(r) for r in suggest.table_replacements(q, words, table).collect()} == {("huose", "house")}
    pairs = spark.createDataFrame([("wrk", "work"), ("alot", "a lot")], "mis string, cor string")
    assert {tuple(r) for r in suggest.listed_replacements(suggest.queries(frame(spark, ["Wrk"])), pairs).collect()} == {("Wrk", "work")}
    camel = {r.cand for r in suggest.camel_edits(suggest.queries(frame(spark, ["handword", "haNdword"])), words).collect()}
    assert "handWord" in camel


AFFIXES = """
SFX D Y 2
SFX D 0 ed [^e]
SFX D e ed e
SFX S N 1
SFX S 0 s .
PFX U Y 1
PFX U 0 un .
"""


def test_affixes(spark):
    rules = affix.rules(spark, AFFIXES)
    roots = spark.createDataFrame([("like", "DSU"), ("work", "DS")], "word string, aff string")
    forms = {(r.word, r.form) for r in affix.expand(roots, rules).collect()}
    assert forms == {("like", f) for f in ("like", "liked", "likes", "unlike", "unliked")} | {("work", f) for f in ("work", "worked", "works")}
    munched = {tuple(r) for r in affix.munch(frame(spark, ["unliked", "works", "WORKS"]), rules).collect()}
    assert ("unliked", "like", "U", "D") in munched and ("works", "work", None, "S") in munched and not any(m[0] == "WORKS" for m in munched)
    correct = {(r.word, r.root) for r in affix.affix_correct(frame(spark, ["Unliked", "unworks", "works"]), roots, rules).collect()}
    assert correct == {("Unliked", "like"), ("works", "work")}
    assert [r[0] for r in affix.expanded_lines(roots.where("word = 'work'"), rules, 2).collect()] == ["work/DS work worked works"]
    assert {tuple(r) for r in affix.expanded_lines(roots.where("word = 'work'"), rules, 4).collect()} == {("work/DS " + f, 3.75) for f in ("work", "worked", "works")}
    with pytest.raises(ValueError):
        affix.parse_affix("SFX A")


def test_learning(spark, words):
    log = spark.createDataFrame([(1, 1, "wrod", "wrld"), (1, 2, "wrld", "world"), (1, 3, "teh", "the"), (2, 1, "alot", "a word"), (2, 2, "q", "zzz")], "user int, at int, mis string, cor string")
    got = {tuple(r) for r in learning.learn_pairs(log, words).collect()}
    assert got == {("wrld", "world"), ("wrod", "world"), ("teh", "the"), ("alot", "a word")}
    first = spark.createDataFrame([("teh", "the")], "mis string, suggestion string")
    assert ("teh", "the") not in {tuple(r) for r in learning.learn_pairs(log, words, first).collect()}
    more = learning.add_words(words, frame(spark, ["zebra", "the", "x9"]))
    assert more.count() == words.count() + 1


def test_reports(spark, words):
    docs = spark.createDataFrame([(1, "the wrold of swimer")], "doc_id long, text string")
    found = check.with_verdict(tokenize.tokens(docs), words)
    lines = {r.word: r.line for r in report.protocol(found, suggest.suggest(found.where("not is_correct").select("word"), words, "ultra")).collect()}
    assert lines["the"] == "*" and lines["wrold"].startswith("& wrold ") and "world" in lines["wrold"] and " 4: " in lines["wrold"]
    fixes = spark.createDataFrame([("wrold", "world"), ("swimer", "swimmer")], "mis string, cor string")
    assert report.replace_all(docs, tokenize.tokens(docs), fixes).first()["text"] == "the world of swimmer"
    ranks = spark.createDataFrame([(1,), (3,), (7,), (0,), (-1,), (20,)], "rank int")
    assert tuple(report.hit_rates(ranks).first()) == (5, 1, 2, 3, 4, 1)


def test_speller(spark):
    s = Speller.build(spark, WORDS, sug_mode="ultra", run_together="true")
    assert {r.word: r.is_correct for r in s.check(["the", "handword", "teh"]).collect()} == {"the": True, "handword": True, "teh": False}
    s = s.add_to_session(["teh"])
    assert s.check(["teh"]).first()["is_correct"]
    assert not s.clear_session().check(["teh"]).first()["is_correct"]
    docs = spark.createDataFrame([(1, "teh <b>wrold</b> http://wrold.org/x.y")], "doc_id long, text string")
    assert [(r.word, r.offset) for r in s.check_documents(docs, mode="html").collect()] == [("wrold", 7)]
    assert s.suggest(["wrold"], limit=1).first()["suggestion"] == "world"


def test_pipe(spark, tmp_path):
    from quillspark.protocol import Pipe

    pipe = Pipe(Speller.build(spark, WORDS, sug_mode="ultra"), str(tmp_path / "own"))
    assert pipe.line("the wrold")[0] == "*" and pipe.line("the wrold")[1].startswith("& wrold ")
    assert pipe.line("!") == [] and len(pipe.line("^the wrold")) == 2 and pipe.line("%") == []
    assert pipe.line("*wrold") == [] and pipe.line("wrold") == ["*", ""]
    assert pipe.line("$$pp") == ["1: wrold"] and pipe.line("$$l") == ["en"]
    pipe.line("#")
    assert dictionaries.read_personal(spark, str(tmp_path / "own")).first()["word"] == "wrold"
    pipe.line("$$cs ignore,3")
    assert pipe.line("$$cr ignore") == ["3"] and pipe.line("xqz") == ["*", ""]
    pipe.line("$$ra teh,the")
    assert pipe.speller.pairs.count() == 1


def test_listings(spark, tmp_path):
    from quillspark.sources import listing

    assert {r.key: r.value for r in listing.options(spark).collect()}["sug-split-char"] == " :-"
    assert listing.modes(spark).count() == len(filters.MODES) and listing.filters(spark).count() == len(filters.REGISTRY)
    assert listing.suggestion_modes(spark).count() == 5
    (tmp_path / "en_US-60.multi").write_text("add x\n")
    (tmp_path / "notes.txt").write_text("x")
    assert [r.code for r in listing.dicts(spark, str(tmp_path)).collect()] == ["en_US"]


def test_own_soundslike(spark):
    from quillspark.functions import language

    language.register_soundslike("first", lambda w: F.substring(w, 1, 1))
    assert frame(spark, ["abc"]).select(language.soundslike("word", "first")).first()[0] == "a"


def test_stream(spark, words, tmp_path):
    from quillspark import streaming

    rows = spark.createDataFrame([(1, "the wrold", "en", "s", 9), (2, "http://x.y/z teh", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = streaming.check_stream(streaming.read_documents(spark, str(tmp_path / "in")), words, ("url",))
    q = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.doc_id, r.word) for r in spark.sql("select * from found").collect()} == {(1, "wrold"), (2, "teh")}


def test_frequency_dictionary(spark):
    docs = spark.createDataFrame([(i, "Common word" + (" rare" if i < 2 else ""), "en") for i in range(4)] + [(9, None, "en")], "doc_id long, text string, lang string")
    assert {(r.word, r.doc_freq) for r in dictionaries.frequency_dictionary(docs).collect()} == {("common", 4), ("word", 4)}


def test_front_coding(spark):
    coded = {r.word: (r.prefix, r.rest) for r in dictionaries.front_coded(frame(spark, ["swim", "swims", "sway", "a"])).collect()}
    assert coded == {"sway": (0, "sway"), "swim": (2, "im"), "swims": (4, "s"), "a": (0, "a")}


def test_word_columns_pass(spark, words):
    rows = spark.createDataFrame([("teh", 1)], "word string, clean int")
    assert check.with_verdict(rows, words).select("clean", F.col("is_correct")).first() == (1, False)


def test_ngrams_score_all_soundslikes(spark):
    """Against the rule itself: all of a score above 0 that tie with one of the ten best, whatever parts they share."""
    import random

    def score(a, b):
        total = 0
        for j in range(1, 4):
            ns = sum(a[i : i + j] in b for i in range(len(a) - j + 1))
            total += ns
            if ns < 2:
                break
        return total - max(0, len(b) - len(a) - 2)

    rng = random.Random(4)
    sounds = sorted({"".join(rng.choices("ABKLMNRT", k=rng.randint(1, 6))) for _ in range(150)})
    words = [*sounds[::25], "XQZ", "XA", "BKLMRT"]
    q = spark.createDataFrame([(w, w) for w in words], "q string, soundslike string")
    d = spark.createDataFrame([(s, s) for s in sounds], "word string, soundslike string")
    want = set()
    for w in words:
        found = sorted(((n, s) for s in sounds if (n := score(w, s)) > 0), reverse=True)
        want |= {(w, s, n) for n, s in found if n >= found[:10][-1][0]}
    assert {tuple(r) for r in suggest.ngrams(q, d).collect()} == want


def test_set_cover():
    """Covers all; never more sets than greedy choice alone takes by more than the best needs; subsets and unique sets are used."""
    import random
    from itertools import combinations

    assert affix.set_cover({"a": {1, 2}, "b": {2}, "c": {3}}) == {"a": {1, 2}, "c": {3}}
    assert affix.set_cover({}) == {}
    rng = random.Random(3)
    for _ in range(200):
        sets = {f"s{i}": set(rng.sample(range(8), rng.randint(1, 4))) for i in range(rng.randint(1, 7))}
        whole = set().union(*sets.values())
        chosen = affix.set_cover(sets)
        assert set().union(*chosen.values()) == whole and sum(map(len, chosen.values())) == len(whole)
        assert all(v <= sets[k] for k, v in chosen.items())
        best = next(n for n in range(1, 9) if any(set().union(*(sets[k] for k in c)) == whole for c in combinations(sets, n)))
        assert len(chosen) <= best + 1


def test_rule_lines_round_trip(spark):
    lines = ["PFX A Y 1", "PFX A 0 re .", "SFX D N 2", "SFX D e ed e", "SFX D 0 ed [^e]"]
    table = affix.rules(spark, lines)
    assert sorted(affix.parse_affix(affix.rule_lines(table))) == sorted(affix.parse_affix(lines))


def test_ngrams_over_blocks(spark):
    """The best of several blocks are those of one; all pairs are scored without being spelled out as rows."""
    import random

    from quillspark.operators import nearest

    rng = random.Random(5)
    sounds = sorted({"".join(rng.choices("ABKLMNRT", k=rng.randint(1, 9))) for _ in range(400)})
    left, right = frame(spark, [*sounds[::9], "", "XQ"]).withColumnRenamed("word", "a"), frame(spark, sounds[1::2]).withColumnRenamed("word", "b")
    one, many = (nearest.best_by_parts(left, right, 3, 10, most) for most in (1000, 30))
    assert "Generate" not in one._jdf.queryExecution().toString()
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()} != set()


def test_near_words_against_all_pairs(spark):
    """What the search by unweighted distances keeps is what all weighted distances give; who has others is told."""
    import random

    from quillspark.functions.distance import Weights, osa, osa_many
    from quillspark.operators import nearest

    rng = random.Random(6)
    xs, ys = ([*sorted({"".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(n)}), *more] for n, more in ((40, ["", "ab" * 40, "z"]), (150, ["", "ba" * 40])))
    who, whom = [x for x in xs for _ in ys], [y for _ in xs for y in ys]
    index = nearest.Entries([{"b": "B", "ys": [{"y": y, "plain": True} for y in ys]}])
    short = [x for x in xs if len(x) <= 64]
    masks, sizes = index.masks(short), nearest.np.array(list(map(len, short)))
    pairs = [(i, j) for i in range(len(short)) for j in range(len(ys))]
    edits = nearest.unit_osa(nearest.np.array([i for i, _ in pairs]), sizes, masks, nearest.np.array([j for _, j in pairs]), index.lengths, index.codes)
    assert edits.tolist() == [osa(short[i], ys[j], Weights(1, 1, 1, 1)) for i, j in pairs]

    rule, want = nearest.Rule(50, 50, 50, 2), set()
    weights = dict(zip(zip(who, whom, strict=True), osa_many(who, whom).tolist(), strict=True))
    for x in xs:
        scores = {y: (50 * weights[x, y] + 50 * 100) // 100 for y in ys}
        most = max(100, sorted(scores.values())[2] + 50) + 50
        want |= {(x, y, weights[x, y], 100) for y in ys if scores[y] <= most} | {(x, None, 0, 0) for y in ys if scores[y] > most}
    words = spark.createDataFrame([("A", x) for x in xs], "a string, x string")
    entries = spark.createDataFrame([("B", y) for y in ys], "b string, y string")
    got = nearest.near_words(words, spark.createDataFrame([("A", "B")], "a string, b string"), entries, rule).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_limit_keeps_the_first(spark):
    """What the search leaves out for a limit is not among the first so many."""
    import random

    from quillspark.sources import dictionaries

    rng = random.Random(7)
    words = sorted({"".join(rng.choices("aeont", k=rng.randint(3, 6))) for _ in range(500)})
    d = dictionaries.build(frame(spark, words[::2]).withColumn("aff", F.lit("")))
    few, all_ = (suggest.suggest(frame(spark, words[1::40]), d, "fast", limit=limit).collect() for limit in (3, 1000))
    assert {tuple(r) for r in few} == {tuple(r) for r in all_ if r["rank"] <= 3} and len(all_) > 3 * len(few)


def test_a_limit_for_many_near_words():
    """Ranked by the score itself, a word of any number of near ones keeps those of the limit; a worker reads a block once."""
    import numpy as np
    import pyarrow as pa

    from quillspark.operators import nearest

    score = np.arange(10_000) // 2
    keep = nearest.Rule(45, 55, 125, 2, 10).wanted(score, score, np.ones(len(score), bool))
    assert np.flatnonzero(keep).tolist() == [*range(10), len(score) - 2] or np.flatnonzero(keep).tolist() == [*range(10), len(score) - 1]
    held = pa.array([[{"b": "B", "ys": [{"y": "abc", "plain": True}]}]])[0]
    assert nearest._block(("s", 0), held)[0] is nearest._block(("s", 0), held)[0] is not nearest._block(("s", 1), held)[0]


def test_modes_share_what_they_compute_alike(spark):
    """Modes of the same words: the shared parts are computed once, the suggestions are those of separate calls."""
    d = dictionaries.build(frame(spark, ["there", "their", "three", "tree", "other", "then", "theme"]).withColumn("aff", F.lit("")))
    words, shared = frame(spark, ["thier", "tehre", "othre"]), {}
    for mode in ("ultra", "fast", "normal"):
        got, want = (suggest.suggest(words, d, mode, limit=5, **more).collect() for more in ({"shared": shared}, {}))
        assert set(got) == set(want) and got
    assert [k if isinstance(k, str) else k[0] for k in shared].count("candidates") == 1 and len(shared) == 7


def test_pairs_of_scans_are_written_once(spark, monkeypatch):
    """Each search writes its scans' pairs in one table; its other tables hold what the other searches found."""
    d = dictionaries.build(frame(spark, ["there", "their", "three", "tree", "other", "then", "theme"]).withColumn("aff", F.lit("")))
    written, stage = [], suggest.stage
    monkeypatch.setattr(suggest, "stage", lambda df, name: (written.append((name, stage(df, name))), written[-1][1])[1])
    suggest.suggest(frame(spark, ["thier", "tehre", "othre"]), d, "fast", limit=5).collect()
    rows = {name: df.select("q", "cand") for name, df in written if name in ("scans", "distances")}
    assert rows["scans"].join(rows["distances"], ["q", "cand"]).isEmpty()


def test_near_soundslikes_by_row_and_by_pair(spark):
    """Soundslikes grouped by row, and told pair by pair without a join, are those of near_sounds()."""
    import random

    rng = random.Random(8)
    a, b = (spark.createDataFrame([(s,) for s in sorted({"".join(rng.choices("*kt", k=rng.randint(0, 6))) for _ in range(60)})], f"{name} string") for name in "ab")
    for edits in (0, 1, 2):
        want = {tuple(r) for r in suggest.near_sounds(a, b, edits).select("a", "b").collect()}
        rows = suggest.sounds_of(a, b, edits).collect()
        assert {(r["a"], x) for r in rows for x in r["bs"]} == want and sum(len(r["bs"]) for r in rows) == len(want) > 0
        assert {tuple(r) for r in a.crossJoin(b).where(suggest.are_near(F.col("a"), F.col("b"), edits)).collect()} == want


def test_ranked_by_score_only_the_best_are_weighed(monkeypatch):
    """Where the score ranks, entries that the wanted ones are sure to beat get no weighted distance; the best are those of all."""
    import random

    import pyarrow as pa

    from quillspark.functions.distance import osa
    from quillspark.operators import nearest

    rng = random.Random(9)
    ys = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(3000)} | {"z" * 30})
    index = nearest.Entries([{"b": "B", "ys": [{"y": y, "plain": True} for y in ys]}])
    words, pairs = pa.array([{"a": "A", "x": "abcdef", "plain": True}]), pa.array([{"a": "A", "bs": ["B", "C"]}])
    weighed, real = [], nearest.osa_coded
    monkeypatch.setattr(nearest, "osa_coded", lambda sizes, *more: (weighed.append(sizes.shape[1]), real(sizes, *more))[1])
    xs, who, whom, word, sound = nearest._near(index, words, pairs, nearest.Rule(45, 55, 125, 2, 10))
    got = sorted(((45 * w + 55 * s) // 100, index.strings[y]) for y, w, s in zip(whom, word, sound, strict=True) if y >= 0)
    scores = sorted((45 * osa("abcdef", y) + 55 * 100) // 100 for y in ys)
    assert [s for s, _ in got[:10]] == scores[:10] and -1 in whom and xs == ["abcdef"]
    assert weighed[0] == 1 and weighed[1] < len(ys) / 4


def test_a_written_table_leaves_no_shuffle_files(spark):
    import glob
    import time

    from quillspark.storage import stage

    def files():
        return {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in glob.glob(f"{d}/*/shuffle_*")}

    before = files()
    stage(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(20):  # they go meanwhile
        if files() <= before:
            break
        time.sleep(0.5)
    assert files() <= before
