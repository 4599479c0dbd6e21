"""Each stage against a plain version, run() against the stages, and odd rows through all of them."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quantloom.llm import mixing, pii, queries, toxicity
from quantloom.llm.common import drop_written, shared_dir, written

from . import brute
from .test_operators import DOCS, ODD, SF, library


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_toxicity_stage(spark, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    grammar, automaton = toxicity.Grammar(model["factors"]), toxicity.finder(model)
    keep = {r.doc_id for r in stages[0].collect() if np.dot(toxicity.describe(toxicity.match(r.text, model, grammar, automaton), len(r.text or "") // 6), model["curve"]) < 0}
    assert {r.doc_id for r in stages[1].collect()} == keep and stages[1].columns == stages[0].columns


def test_simhash_stage(stages):
    comp = brute.simhash([(r.doc_id, r.text) for r in stages[1].collect()])
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({c for _, c in comp.values()})


def test_pii_stage(stages):
    model, table = pii.train(), pii.char_classes()
    rows = {r.doc_id: r.text for r in stages[2].collect()}
    got = {r.doc_id: r for r in stages[3].collect()}
    assert set(got) == set(rows)
    for d, text in rows.items():
        assert got[d].n_chars == len(got[d].text)
        assert not any(brute.base(got[d].text)[k] for k in ("email", "card"))
        if not pii.all_spans([text], model, table)[0][1]:
            assert got[d].text == text


def test_mixing_stage(stages):
    before, after = stages[3].collect(), Counter(r.doc_id for r in stages[4].collect())
    size = {r.doc_id: len(brute.WORDS.findall(r.text)) for r in before}
    by = Counter()
    for r in before:
        by[r.source] += size[r.doc_id]
    goal = mixing.capped_targets(dict(by))
    for s in by:
        taken = sum(after[r.doc_id] * size[r.doc_id] for r in before if r.source == s)
        assert abs(taken - goal[s]) <= max(2, 0.01 * goal[s])
    assert max(after.values()) <= 3


def test_mixing_keeps_documents_without_words(spark):
    rows = [(1, None, None, "a", None), (2, "", None, None, None), (3, " \n", None, "b", None), (4, "one two", None, "a", None)]
    got = Counter(r.doc_id for r in cp.mix_sources(spark, spark.createDataFrame(rows, DOCS), SF).collect())
    assert [got[i] for i in (1, 2, 3)] == [1, 1, 1]


def test_bpe_stage_and_run(spark, stages):
    t = library()
    want = Counter((r.doc_id, len(ids := t.encode(r.text, add_special_tokens=False).ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t.decode(ids, skip_special_tokens=False))) for r in stages[4].collect())
    assert Counter(map(tuple, stages[5].collect())) == want
    assert Counter(map(tuple, cp.run(spark, SF).collect())) == want
    assert Counter(map(tuple, queries.QUERIES["pipeline"](spark, SF).collect())) == want


def test_odd_rows(spark):
    rows = [(i if i % 5 else None, t, None if i % 2 else "en", [None, "a", "b"][i % 3], None) for i, t in enumerate(ODD)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).withColumn("fp", F.lit(None).cast("string"))
    for empty in (False, True):
        d = docs.limit(0) if empty else docs
        for name, stage in cp.STAGES:
            out = written(stage(spark, d, SF), f"odd-{name}")
            assert (out.count() == 0) == empty
            if name != "bpe":
                assert out.columns == docs.columns and {r.size for r in out.select("size").distinct().collect()} <= {"x"}
                d = out


def test_drop_written(spark):
    df = written(spark.range(3).toDF("id"), "gone")
    assert df.count() == 3 and shared_dir(spark)
    drop_written(spark)
    with pytest.raises(Exception):
        written(spark.range(1).toDF("id"), "x").sparkSession.read.parquet(df.inputFiles()[0]).count()
