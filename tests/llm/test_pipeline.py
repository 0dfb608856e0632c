import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_leaks, words
from tests.llm.test_simhash import brute_fingerprint
from tillflow.llm import cotraining, quality_rules
from tillflow.llm.queries import clean_label
from tillflow.llm.shared import settle

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, FOLDER), name)
        tables.append(docs)
    return tables


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns_and_only_lose_rows(stages):
    ids = [set(texts(t)) for t in stages[:-1]]
    assert all(t.columns == stages[0].columns for t in stages[:-1])
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert {r.doc_id for r in stages[-1].collect()} == ids[-1]


def test_quality_stages_apply_their_verdicts(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = cotraining.train(stages[0], labels, clean_label())
    good = {r.doc_id for r in stages[0].collect() if model.views(r.text, r.lang, r.source, r.n_chars)[2] >= 0.5}
    assert set(texts(stages[1])) == good
    rules = quality_rules.train(stages[0], labels)  # the stage learns from the original documents
    kept = set()
    for i, text in texts(stages[1]).items():
        n, _, _, _, repeated = quality_rules.text_statistics(text)
        if n >= 50 and 2 * repeated <= n and rules.probability(text) >= 0.5:
            kept.add(i)
    assert set(texts(stages[2])) == kept
    clean = {r.doc_id for r in labels.where(clean_label()).collect()}
    long = {i for i, t in texts(stages[0]).items() if len((t or "").split()) >= 50}
    assert len(set(texts(stages[2])) & clean & long) / len(clean & long) > 0.95


def test_near_copies_go(stages):
    before, after = texts(stages[2]), texts(stages[3])
    prints = {i: brute_fingerprint(t) for i, t in before.items()}
    values = sorted(set(prints.values()))
    array, root = np.array(values, np.uint64), {v: v for v in values}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, v in enumerate(values):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 2):
            a, b = sorted((find(v), find(values[j])))
            root[b] = a
    low = {}
    for i, p in prints.items():
        low[find(p)] = min(low.get(find(p), i), i)
    assert set(after) == set(low.values()) and all(after[i] == before[i] for i in after)


def test_passages_of_the_benchmark_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    hit = {int(r[0]): r for r in brute_leaks(list(before.items()), items)}
    assert set(after) == {i for i, r in hit.items() if 2 * r[2] <= r[1]}
    assert not any(r[5] for r in brute_leaks(list(after.items()), items))
    for i, text in after.items():
        assert text == before[i] if not hit[i][5] else len(words(text)) <= hit[i][1] - hit[i][2]


def test_run_gives_the_last_stage(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    mine = sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select(*columns).collect())
    assert mine == sorted(tuple(r) for r in stages[-1].select(*columns).collect())


def test_learned_rule_rejects_poor_documents_among_survivors(spark, stages):
    """Poor documents that the stage before has missed, put among its survivors, fall to the learned rule alone."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    poor_ids = labels.where("quality = 0").select("doc_id").join(stages[1].select("doc_id"), "doc_id", "left_anti")
    long = []
    for i, text in texts(stages[0].join(poor_ids, "doc_id", "left_semi")).items():
        n, _, _, _, repeated = quality_rules.text_statistics(text)
        if n >= 50 and 2 * repeated <= n:
            long.append(i)
    assert len(long) > 5
    # New ids: these are documents without a label.
    missed = stages[0].where(F.col("doc_id").isin(long)).withColumn("doc_id", -1 - F.col("doc_id"))
    kept = set(texts(corpus_pipeline.quality_rules_stage(spark, stages[1].unionByName(missed), FOLDER)))
    assert len([i for i in long if -1 - i in kept]) / len(long) < 0.1
    assert len(kept & set(texts(stages[2]))) / len(texts(stages[2])) > 0.95
