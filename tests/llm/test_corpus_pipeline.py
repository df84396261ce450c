"""Each stage of the corpus pipeline on its own input, beside brute force."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import WORD, brute_components, targets
from varloom.llm import pii, quality
from varloom.llm.common import materialize

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        out.append((name, docs))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in stages[1:]] == ["quality_classifier", "near_dedup", "pii", "mixing", "packing"]
    first = stages[0][1]
    assert all(df.dtypes == first.dtypes for _, df in stages[1:5])


def test_quality_keeps_the_good(spark, stages):
    labels = rows(spark.read.parquet(f"{DATA}/labels.parquet"))
    before, after = rows(stages[0][1]), rows(stages[1][1])
    assert after.items() <= before.items()
    right = [(k in after) == bool(labels[k].quality) for k in before if k in labels]
    assert np.mean(right) > 0.97
    machine = quality.train(stages[0][1], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r.doc_id for r in quality.score_documents(stages[0][1], machine).collect() if r.predicted} == set(after)


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1][1]), rows(stages[2][1])
    want = {k for k, _, c in brute_components([(k, r.text) for k, r in before.items()]) if k == c}
    assert set(after) == want and all(after[k] == before[k] for k in after)


def test_identifiers_are_masked(stages):
    before, after = rows(stages[2][1]), rows(stages[3][1])
    assert before.keys() == after.keys()
    spans = {r.doc_id: [(x.start, x.end, x.kind) for x in r.all_spans] for r in pii.find(stages[2][1]).collect()}
    for k, r in before.items():
        text, at = [], 0
        for s, e, kind in sorted(spans[k]):
            if s >= at:
                text += [r.text[at:s], f"<{kind}>"]
            at = max(at, e)
        want = "".join(text) + r.text[at:]
        assert after[k].text == want and after[k].n_chars == (len(want) if spans[k] else r.n_chars)
    assert not any(re.search(r"[\w.]+@[\w-]+\.[\w.]+", r.text) for r in after.values())


def test_mix_meets_targets(stages):
    sizes, taken = Counter(), Counter()
    for r in stages[3][1].collect():
        sizes[r.source] += len(WORD.findall(r.text))
    for r in stages[4][1].collect():
        taken[r.source] += len(WORD.findall(r.text))
    want = targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert {r.doc_id for r in stages[4][1].collect()} <= {r.doc_id for r in stages[3][1].collect()}


def test_every_token_is_packed_once(stages):
    from tokenizers import Tokenizer

    from varloom.llm.subwords import vocabulary_path

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages[4][1].collect():
        want[r.doc_id] += len(t.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in stages[5][1].collect():
        got[r.doc_id] += r.length
    assert got == want


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() > 0 and corpus_pipeline.ORACLE_SQL is None
