"""Scalar rules on cases worked out by hand, and against plain Python twins."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import distance, encoding, language
from quillspark.functions.phonet import Phonet
from quillspark.sources.options import OptionError, Options, itemize, join_list, split_list


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{k} string" for k in range(len(values[0]) if isinstance(values[0], tuple) else 1)))
    return [r[1] for r in rows.select("i", expression.alias("x")).orderBy("i").collect()]


def test_case_patterns(spark):
    words = ["the", "The", "THE", "tHe", "I", "a", "McDonald", "Été", "o'Neil"]
    assert column(spark, words, language.case_pattern("c0")) == ["AllLower", "FirstUpper", "AllUpper", "Other", "AllUpper", "AllLower", "Other", "FirstUpper", "Other"]


def test_keys(spark):
    assert column(spark, ["Été", "don't", "Straße"], language.clean("c0")) == ["ete", "dont", "straße"]
    assert column(spark, ["hello", "apple", "gogo", "kick", "baab"], language.soundslike("c0")) == ["hl", "*pl", "gg", "kck", "bb"]


def test_accepts(spark):
    cases = {("the", "the"): True, ("The", "the"): True, ("THE", "the"): True, ("tHe", "the"): False, ("mcdonald", "McDonald"): False, ("MCDONALD", "McDonald"): True, ("Paris", "Paris"): True, ("paris", "Paris"): False}
    assert column(spark, list(cases), language.accepts("c0", "c1")) == list(cases.values())
    assert column(spark, [("mcdonald", "McDonald")], language.accepts("c0", "c1", ignore_case=True)) == [True]


def test_edge_characters(spark):
    own = language.Language(begin="'", middle="'", end="'")
    assert column(spark, [("'the", "the"), ("the'", "the"), ("'The'", "the")], language.accepts("c0", "c1", own)) == [True, True, True]


def test_camel(spark):
    assert column(spark, ["camelCase", "XMLFile", "HTML", "getURLNow"], language.split_camel("c0")) == [["camel", "Case"], ["XML", "File"], ["HTML"], ["get", "URL", "Now"]]


def test_fix_case(spark):
    assert column(spark, [("AllUpper", "word"), ("FirstUpper", "word"), ("FirstUpper", "McX"), ("Other", "word")], language.fix_case("c0", "c1")) == ["WORD", "Word", "McX", "word"]


def test_valid(spark):
    assert column(spark, ["don't", "'tis", "a", "", "x1"], language.is_valid("c0")) == [True, False, True, False, False]


@pytest.mark.parametrize(("a", "b", "d"), [("teh", "the", 90), ("recieve", "receive", 90), ("abc", "abcd", 95), ("abc", "abc", 0), ("", "ab", 190), ("kitten", "sitting", 295), ("ca", "abc", 285)])
def test_osa(a, b, d):
    assert distance.osa(a, b) == d


def test_osa_expression(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 6))), "".join(rng.choices("abc", k=rng.randint(0, 6)))) for _ in range(60)]
    assert column(spark, pairs, distance.osa_expression(F.col("c0"), F.col("c1"))) == [distance.osa(*p) for p in pairs]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_osa_properties(a, b):
    d = distance.osa(a, b)
    assert d == distance.osa(b, a)
    assert (d == 0) == (a == b)
    assert d >= 95 * abs(len(a) - len(b)) - 5 * min(len(a), len(b))
    assert distance.limited_osa(a, b, 1) in (d, distance.FAR)


def test_typo():
    assert distance.typo("the", "the") == 0
    assert distance.typo("the", "teh") == 60  # a swap
    assert distance.typo("cat", "cst") == 70  # a and s are neighbours
    assert distance.typo("cat", "cpt") == 110
    assert distance.typo("cat", "ct") <= 100


def test_ngram(spark):
    # level 1: a, b, c; level 2: ab, bc; level 3: abc
    assert column(spark, [("abc", "xabcx"), ("ab", "zz"), ("ab", "abcdefg")], distance.ngram_score(3, F.col("c0"), F.col("c1"))) == [6, 0, 0]


def test_phonet():
    table = Phonet.parse("version 1\nfollowup 1\ncollapse_result 0\nGH _\nGN$ N\nG K\nDG(EIY) J\nD T\nPH< F\nF F\nTCH-- _\nCH X\nT T\nA^ *\nN N\nO O\nSCH SH\nCHS X\nCH G\nS S\n")
    assert table.key("gh") == ""
    assert table.key("dge") == "J"
    assert table.key("phn") == "FN"
    assert table.key("tch") == "X"
    assert table.key("agn") == "*N"
    assert table.key("agno") == "*KNO"
    german = Phonet.parse("CHS X\nCH G\nHAU--1 H\nH H\nSCH SH\nS S\n" + "\n".join(f"{c} {c}" for c in "DURNITFAEKL"))
    assert german.key("fuchs") == "FUX"
    assert german.key("durchschnitt") == "DURGSHNIT"  # SCH follows up CHS
    assert german.key("schaukel") == "SHAUKEL"  # HAU has a lower priority
    assert Phonet.parse("L L\nA A").key("lalla") == "LALA"
    with pytest.raises(ValueError):
        Phonet.parse("(( x")


def test_normal_forms(spark):
    assert column(spark, ["é", "abc", None], encoding.normalize("c0")) == ["é", "abc", None]
    rows = spark.createDataFrame([(bytearray(b"a\xffb"),)], "b binary")
    assert rows.select(encoding.repaired("b")).first()[0] == "a?b"


def test_options():
    o = Options.of("lang de\n# no\nignore 2", {"add-filter": "html", "enable-camel-case": "", "sug-split-char": "-:a\\:b"})
    assert (o["lang"], o["ignore"], o["filter"], o["camel-case"], o["sug-split-char"]) == ("de", 2, ("url", "html"), True, ("-", "a:b"))
    assert o.set("reset-ignore", "")["ignore"] == 1
    assert o.set("rem-filter", "url")["filter"] == ("html",)
    for key, value in (("nope", "1"), ("ignore", "-1"), ("camel-case", "yes"), ("add-lang", "x")):
        with pytest.raises(OptionError):
            o.set(key, value)
    assert split_list(join_list(["a:b", "c\\d"])) == ["a:b", "c\\d"]
    assert itemize("+a, -b, !, c") == [("+", "a"), ("-", "b"), ("!", ""), ("+", "c")]


def test_distances_of_codes():
    """Rows of two bytes and wider ones, keyboards of few and many keys: the same as pair by pair."""
    rng = random.Random(5)
    many = frozenset((chr(97 + i), chr(98 + i)) for i in range(80))
    for letters, size in (("abqwsz", 9), ("éß\U0001f600ab", 9), ("ab", 220)):
        a, b = (["".join(rng.choices(letters, k=rng.randint(0, size))) for _ in range(60)] for _ in range(2))
        assert distance.osa_many(a, b).tolist() == [distance.osa(x, y) for x, y in zip(a, b, strict=True)]
        for near in (distance.neighbours(), many, frozenset()):
            assert distance.typo_many(a, b, near).tolist() == [distance.typo(x, y, near) for x, y in zip(a, b, strict=True)]
    assert distance.codes([]).shape == (0, 0) and distance.codes(["ab"]).dtype == "uint16" and len(distance.osa_many([], [])) == 0
