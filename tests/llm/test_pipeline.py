"""The pipeline stage by stage, each against plain Python on the stage's own input."""

from tests.conftest import SF

import corpus_pipeline
from quillspark.llm import packing, repetition
from quillspark.llm.common import load, stage
from quillspark.llm.token_ids import tokenizer_path
from tests.llm.test_corpus_operators import check_packing, cut_lines, linked

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = load(spark, SF, "documents")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = stage(step(spark, docs, SF), "test")
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == COLUMNS
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    before, after = seen["quality rules"]
    assert {r.doc_id for r in after.collect()} == {d for (d, _, _), x in zip(before, repetition.describe([t for _, t, _ in before]), strict=True) if x[-1]}
    before, after = seen["line dedup"]
    cut = cut_lines(sorted((d, t) for d, t, _ in before))
    assert {r.doc_id: r.text for r in after.collect()} == {d: cut[d] for d, t, _ in before if cut[d].strip() or cut[d] == t}
    before, after = seen["near duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in linked([(d, t) for d, t, _ in before], 80).items() if d == c)
    before, after = seen["source mix"]
    total = sum(len(t.split()) for _, t, _ in before)
    assert abs(sum(len(r.text.split()) for r in after.collect()) - total) <= 0.05 * total
    before, after = seen["packing"]
    n, bound = check_packing([(d, t) for d, t, _ in before], after.collect(), tokenizer_path("word_bpe_49k.json"))
    assert n <= bound + 1
    assert packing.CAPACITY == 2048


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
