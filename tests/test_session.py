"""The speller with everything that options can name: dictionaries by name, lists, keyboards, affixes."""

import pytest

from quillspark.functions import distance
from quillspark.operators import affix, suggest
from quillspark.session import Speller
from quillspark.sources import dictionaries

RULES = "PFX A Y 1\nPFX A 0 re .\nSFX D Y 1\nSFX D 0 ed [^e]\n"


@pytest.fixture
def folder(spark, tmp_path):
    words = spark.createDataFrame([("walk", "AD"), ("talk", ""), ("House", "")], "word string, aff string")
    dictionaries.save(dictionaries.build(words), str(tmp_path / "main"))
    (tmp_path / "more.pws").write_text("personal_ws-1.1 en 2 utf-8\nzebra\nyak\n")
    (tmp_path / "fix.prepl").write_text("personal_repl-1.1 en 1 utf-8\nteh the cat\n")
    (tmp_path / "all.multi").write_text("# both\nadd main\nadd more\n")
    (tmp_path / "bad.multi").write_text("get main\n")
    (tmp_path / "none.alias").write_text("# nothing\n")
    (tmp_path / "plain").write_text("alpha\nbeta!\n")
    return str(tmp_path)


def accepted(speller, words):
    return {r.word for r in speller.check(words).where("is_correct").collect()}


def test_dictionaries_by_name(spark, folder):
    speller = Speller.open(spark, folders=(folder,), master="all", extra_dicts="fix:more", wordlists=f"{folder}/plain")
    assert accepted(speller, ["walk", "house", "House", "zebra", "yak", "alpha", "beta", "gamma"]) == {"walk", "House", "zebra", "yak", "alpha", "beta"}
    assert [tuple(r) for r in speller.pairs.collect()] == [("teh", "the cat")]
    alias = Speller.open(spark, folders=(folder,), master="both", dict_alias="both add main;add more")
    assert accepted(alias, ["talk", "zebra", "alpha"]) == {"talk", "zebra"}
    assert accepted(Speller.open(spark, folders=("/nowhere", folder), master="more"), ["yak", "walk"]) == {"yak"}
    for name in ("bad", "none", "missing", "fix"):
        with pytest.raises(dictionaries.DictionaryError):
            Speller.open(spark, folders=(folder,), master=name)


def test_lists_are_merged_when_saved(spark, folder):
    own, repl = f"{folder}/own.pws", f"{folder}/own.prepl"
    speller = Speller.open(spark, folders=(folder,), master="main", personal=own, repl=repl)
    log = spark.createDataFrame([("u", 1, "tlak", "talk")], "user string, at int, mis string, cor string")
    speller.add_to_personal(["gnu"]).store_replacements(log).save_all()
    speller.add_to_personal(["emu"]).save_all()
    again = Speller.open(spark, folders=(folder,), master="main", personal=own, repl=repl)
    assert accepted(again, ["gnu", "emu", "walk", "elk"]) == {"gnu", "emu", "walk"}
    assert [tuple(r) for r in again.pairs.collect()] == [("tlak", "talk")]


def test_affixes_in_check(spark, folder):
    speller = Speller.open(spark, folders=(folder,), master="main", affixes=affix.rules(spark, RULES))
    told = {r.word: (r.is_correct, r.root) for r in speller.check(["walked", "rewalked", "talked", "walk", "rewalk"]).collect()}
    assert told == {"walked": (True, "walk"), "rewalked": (True, "walk"), "talked": (False, None), "walk": (True, None), "rewalk": (True, "walk")}
    lines = {r.word: r.line for r in speller.with_options(suggest="false").report(spark.createDataFrame([(1, "walked talked")], "doc_id int, text string")).collect()}
    assert lines == {"walked": "+ walk", "talked": "# talked 7"}


def test_keyboards_reach_the_scores(spark, tmp_path):
    (tmp_path / "own.kbd").write_text("# two keys\nqx\nkey öO\n")
    words = ["xat", "zat", "Otter"]
    plain = {r.suggestion: r.adj for r in Speller.build(spark, words, keyboard="standard").suggest(["qat"]).collect()}
    own = {r.suggestion: r.adj for r in Speller.build(spark, words, keyboard=str(tmp_path / "own.kbd")).suggest(["qat"]).collect()}
    assert plain["xat"] == plain["zat"] and own["xat"] < own["zat"] == plain["zat"]
    board = distance.Keyboard.of([("q", "x")], ["öO"])
    rows = spark.createDataFrame([("ö", "O"), ("q", "x"), ("q", "z"), (None, "a")], "a string, b string")
    assert [r[0] for r in rows.select(distance.typo_distance("a", "b", board)).collect()] == [0, 70, 110, None]


def test_vectorised_distances():
    import random

    rng = random.Random(1)
    a = ["".join(rng.choices("abqwes日é", k=rng.choice([0, 1, 2, 3, 5, 8, 12, 30]))) for _ in range(3000)]
    b = [rng.choice(a) if rng.random() < 0.3 else "".join(rng.sample(x, len(x))) for x in a]
    assert distance.osa_many(a, b).tolist() == [distance.osa(x, y) for x, y in zip(a, b, strict=True)]
    assert distance.typo_many(a, b).tolist() == [distance.typo(x, y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("mode", ["ultra", "fast", "normal", "slow", "bad-spellers"])
def test_modes_find_near_words(spark, mode):
    """Each word that one letter's change hides is found in all modes; ranks have no gaps."""
    words = ["house", "mouse", "horse", "hose", "those", "spelling", "spilling", "necessary", "accessory", "receive", "relieve", "phone", "bone", "drone"]
    typed = ["huose", "hosue", "speling", "neccesary", "recieve", "fone", "xyzzy", "hhhh"]
    rows = Speller.build(spark, words, sug_mode=mode).suggest(typed).collect()
    assert {("huose", "house"), ("hosue", "house"), ("speling", "spelling"), ("recieve", "receive")} <= {(r.q, r.suggestion) for r in rows}
    ranks = [(r.q, r.rank) for r in rows]
    for q in {q for q, _ in ranks}:
        assert sorted(k for x, k in ranks if x == q) == list(range(1, 1 + sum(x == q for x, _ in ranks)))


def test_hardness(spark):
    """3: nothing found; 1: all near; 2: far ones, but none worse than the third; 0: enough."""
    mode = suggest.MODES["normal"]
    q = spark.createDataFrame([("none",), ("near",), ("few",), ("many",)], "q string")
    rows = [("near", f"n{i}", 100, f"n{i}") for i in range(2)] + [("few", f"f{i}", 100, f"f{i}") for i in range(2)] + [("many", f"m{i}", 50 + i, f"m{i}") for i in range(5)]
    told = spark.createDataFrame([(a, b, c, d, True) for a, b, c, d in rows], "q string, cand string, score int, c_clean string, counted boolean")
    cands = told.select("q", "cand").unionByName(spark.createDataFrame([("few", "far"), ("many", "far")], "q string, cand string"))
    assert {r.q: r.hard for r in suggest.hardness(q, cands, told, mode).collect()} == {"none": 3, "near": 1, "few": 2, "many": 0}


def test_one_wrong_part_of_a_camel_case_word(spark):
    words = ["house", "mouse", "garden"]
    found = {(r.q, r.suggestion) for r in Speller.build(spark, words, sug_mode="ultra", camel_case="true").suggest(["HuoseGarden", "hosueGarden"]).collect()}
    assert ("HuoseGarden", "HouseGarden") in found and ("hosueGarden", "houseGarden") in found


def test_listed_corrections_have_to_be_words(spark):
    words = dictionaries.build(spark.createDataFrame([("the", ""), ("cat", "")], "word string, aff string"))
    pairs = spark.createDataFrame([("teh", "the"), ("teh", "thee"), ("tehcat", "the cat"), ("tehcat", "the cot")], "mis string, cor string")
    q = suggest.queries(spark.createDataFrame([("teh",), ("tehcat",)], "word string"))
    assert {tuple(r) for r in suggest.listed_replacements(q, pairs, words).collect()} == {("teh", "the"), ("tehcat", "the cat")}
