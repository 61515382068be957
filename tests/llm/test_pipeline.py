"""The pipeline's stages, one by one, against brute force."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from gnomon.llm import decontamination, sharding, toxicity

from .helpers import near_classes


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n for n, *_ in stages] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_toxicity_keeps_what_scores_below(spark, sf_dir, stages):
    _, before, after = stages[0]
    scored = toxicity.score(before, toxicity.learn(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))).toPandas()
    assert {r.doc_id for r in after.collect()} == set(scored[scored.score < toxicity.THRESHOLD].doc_id)


def test_one_of_each_class_stays(stages):
    _, before, after = stages[1]
    classes = near_classes([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(classes.values()))


def test_only_contaminated_go(spark, sf_dir, stages):
    _, before, after = stages[2]
    scanner = decontamination.Scanner([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if not scanner.scan(r.text)[1]}


def test_mix_and_shards_keep_every_copy(stages):
    _, before, after = stages[3]
    n = Counter(r.doc_id for r in after.collect())
    assert set(n) <= {r.doc_id for r in before.collect()} and max(n.values()) <= 2
    last = stages[4][2].toPandas()
    assert Counter(last.doc_id.tolist()) == n and set(last.shard) <= set(range(sharding.SHARDS))
    for _, g in last.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
