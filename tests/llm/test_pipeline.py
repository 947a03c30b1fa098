"""The pipeline's stages against plain versions, each on its own input."""

import pandas as pd
import pytest

import corpus_pipeline
from marketloom.llm import language
from test_llm_queries import AWKWARD, SF, brute_components, brute_lines, check_packing


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        out[name] = docs
    return {k: v.toPandas() for k, v in out.items()}


def test_stages_keep_the_columns_of_documents(stages):
    names = list(stages)
    assert [n for n, _ in corpus_pipeline.STAGES] == names[1:] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    for before, after in zip(names[:4], names[1:5]):
        assert list(stages[after]) == list(stages["documents"]) and set(stages[after].doc_id) <= set(stages[before].doc_id)


def test_language_stage(spark, stages):
    model = language.train_language_model(spark.read.parquet(f"{SF}/documents.parquet"), language.F.lit(True))
    p, known = language.probabilities(model.parts(), stages["documents"].text.tolist())
    want = stages["documents"].doc_id[known & (p.max(axis=1) >= 0.5)]
    assert set(stages["language ID"].doc_id) == set(want) and len(want) > 0.9 * len(known)


def test_line_stage(stages):
    want = brute_lines([(d, t) for d, t in zip(stages["language ID"].doc_id, stages["language ID"].text)])
    want = {d: text for d, (text, n, gone) in want.items() if not gone or gone < n}
    got = stages["line dedup"]
    assert dict(zip(got.doc_id, got.text)) == want and (got.n_chars == got.text.str.len()).all()


def test_line_stage_calls_python_once(spark):
    """The filter on what was cleaned is not pushed below it, where it would clean each text again in a second worker."""
    plan = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_near_dedup_stage(stages):
    parts = brute_components(list(zip(stages["line dedup"].doc_id, stages["line dedup"].text)), 5, 80)
    assert set(stages["MinHash near-dedup"].doc_id) == {d for d, (_, root) in parts.items() if d == root}


def test_decontamination_stage(spark, stages):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text
    before, after = stages["MinHash near-dedup"], set(stages["benchmark decontamination"].doc_id)
    held = {d for d, t in zip(before.doc_id, before.text) if any(i.lower() in t.lower() for i in items)}
    words = {w for i in items for w in zip(*[i.lower().split()[k:] for k in range(5)])}
    clean = {d for d, t in zip(before.doc_id, before.text) if not words & set(zip(*[t.lower().split()[k:] for k in range(5)]))}
    assert held and not held & after and clean <= after


def test_packing_stage(spark, stages):
    check_packing(stages["packing"], stages["benchmark decontamination"])
    assert {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == set(zip(*(stages["packing"][c] for c in ("doc_id", "start", "ids_crc32"))))


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_rows(spark, empty):
    rows = [(i, t, "en", "web", 1, "clash", 0.5) for i, t in AWKWARD] + [(None, "a text without an id", "en", "web", 1, "x", 0.1), (5, "a b c d e f g h", "en", "web", 1, "x", 0.1)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long, item_id string, h double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "item_id", "h"]
    assert corpus_pipeline.packing(spark, docs, SF).count() == 0 if empty else corpus_pipeline.packing(spark, docs, SF).count() > 0
