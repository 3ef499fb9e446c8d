"""Queries against the same question in SQL, and those without SQL against their contracts."""

import pytest
from tests.conftest import SF, same_rows

from quillspark import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_sql_twin(spark, duck, name):
    ours, theirs = same_rows(plans.QUERIES[name](spark, SF), duck.sql(plans.ORACLE_SQL[name]))
    assert ours == theirs


@pytest.mark.parametrize("name", ["html_filter", "context_filter", "tex_filter", "texinfo_filter", "nroff_filter", "markdown_filter"])
def test_filters_keep_lengths(spark, name):
    key = "page_id" if name in ("html_filter", "context_filter") else "doc_id"
    if key == "page_id":
        rows = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id as key", "html as text")
    else:
        marked = plans.checking._in_markup(spark.read.parquet(f"{SF}/documents.parquet"), getattr(plans.checking, name.split("_")[0].upper()))
        rows = marked.selectExpr("doc_id as key", "text")
    before = {r.key: r.text for r in rows.collect()}
    after = {r[key]: r["filtered"] for r in plans.QUERIES[name](spark, SF).collect()}
    assert before.keys() == after.keys()
    for k, text in before.items():
        assert len(after[k]) == len(text)
        assert all(b in (a, " ") for a, b in zip(text, after[k], strict=True))


def test_folded_distance_equals_arrow(spark):
    a = {tuple(r) for r in plans.QUERIES["osa_weighted_distance"](spark, SF).collect()}
    b = {tuple(r) for r in plans.QUERIES["osa_folded_distance"](spark, SF).collect()}
    assert a == b


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["word", "n"]
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES) <= set(__spark_entry__.queries())


def test_modes_find_more(spark):
    rows = {r["mode"]: r for r in plans.QUERIES["hit_rate_tally"](spark, SF).collect()}
    assert rows["ultra"]["n"] == rows["fast"]["n"] == rows["normal"]["n"] > 0
    assert rows["normal"]["any_rank"] >= rows["fast"]["any_rank"] >= rows["ultra"]["any_rank"]


def test_munch_lists_expand_to_the_list(spark):
    from quillspark.operators import affix

    rules = affix.rules(spark, plans.correcting.AFFIXES)
    words = {r[0] for r in plans.checking.dictionary(spark, SF).select("word").collect()}
    for name in ("munch_list", "munch_list_simple"):
        roots = plans.QUERIES[name](spark, SF)
        assert roots.count() < len(words)
        forms = {r[0] for r in affix.expand(roots, rules).where("prefix is null or suffix is null").select("form").collect()}
        assert words <= forms
