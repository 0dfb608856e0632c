import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_ROWS
from tillflow.llm import cotraining, linear, quality_rules
from tillflow.llm.queries import clean_label

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, repeats = WORD.findall(text), set(), 0
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #\n\t\x0b\x85 é", max_size=60))
def test_statistics_equal_brute_force(text):
    assert quality_rules.text_statistics(text) == brute(text)


def test_rules_reject_junk_and_keep_the_rest(table):
    docs, labels = table("documents", "sf0.01"), table("labels", "sf0.01")
    model = quality_rules.train(docs, labels)
    report = quality_rules.quality_report(docs, model).cache()
    assert [tuple(r)[1:6] for r in report.orderBy("doc_id").limit(100).collect()] == [
        brute(r.text) for r in docs.orderBy("doc_id").limit(100).collect()
    ]
    shares = {r["quality"]: r["kept"] for r in report.drop("quality").where("not base_failed").join(labels, "doc_id")
              .groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.95 and shares.get(0, 0) < 0.2
    assert report.where("base_failed and kept").count() == 0
    assert quality_rules.keep_good(docs, model).count() == report.where("kept").count()
    report.unpersist()


def test_rules_on_odd_rows_and_without_labels(odd, none, table):
    labels = table("labels").where("false")
    model = quality_rules.train(odd, labels)
    found = {(r.doc_id, r.n_words): r for r in quality_rules.quality_report(odd, model).collect()}
    assert sum(1 for _ in found) <= len(ODD_ROWS)
    for i, text, *_ in ODD_ROWS:
        r = found[i, brute(text)[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and r.kept == (not r.base_failed)
    kept = quality_rules.keep_good(odd, model)
    assert kept.columns == odd.columns
    assert quality_rules.quality_report(none, model).count() == 0
    assert quality_rules.keep_good(none, quality_rules.train(none, labels)).count() == 0


def test_cotrained_views_tell_clean_documents(table):
    docs, labels = table("documents", "sf0.1"), table("labels", "sf0.1")
    # Learn from two thirds of the labels and look at the rest.
    unseen = labels.where("doc_id % 3 = 0")
    model = cotraining.train(docs, labels.where("doc_id % 3 <> 0"), clean_label(), unlabelled_rows=1000)
    scored = cotraining.score_documents(docs, model).join(unseen, "doc_id").withColumn("good", clean_label())
    shares = {r["good"]: r for r in scored.groupBy("good").agg(
        F.avg(F.col("kept").cast("int")).alias("both"),
        F.avg((F.col("text_p") >= 0.5).cast("int")).alias("text"),
        F.avg((F.col("metadata_p") >= 0.5).cast("int")).alias("metadata"),
    ).collect()}
    assert shares[True]["both"] > 0.95 and shares[False]["both"] < 0.35
    # Neither view alone rejects what the two together do.
    assert shares[False]["both"] < shares[False]["metadata"]


def test_cotraining_exchanges_labels():
    """Of ten known rows no text shares a word with the unknown ones; the metadata tells the classes apart."""
    good, bad = "plain words of prose", "win cash now"
    known = [(good, 1.0)] * 5 + [(bad, 0.0)] * 5
    unknown = [("quiet evening garden", 1.0)] * 20 + [("cheap pills offer", 0.0)] * 20
    import numpy as np

    metadata = np.array([[y * 4 - 2] for _, y in known + unknown])
    texts = [t for t, _ in known + unknown]
    labels = [int(y) for _, y in known] + [None] * 40
    weights, bias, _ = cotraining.co_train(texts, metadata, labels, rounds=4, confident=0.6)
    assert linear.text_margin(weights, bias, "quiet evening garden") > linear.text_margin(weights, bias, "cheap pills offer") + 0.5


def test_cotraining_on_odd_rows_and_without_labels(odd, none, table):
    labels = table("labels").where("false")
    model = cotraining.train(odd, labels, clean_label())
    assert cotraining.score_documents(odd, model).where("kept and quality_p > 0.5").count() == len(ODD_ROWS)
    assert cotraining.keep_good(odd, model).columns == odd.columns
    assert cotraining.keep_good(none, model).count() == 0


def test_calibration_follows_the_share_of_a_margin():
    import numpy as np

    rng = np.random.default_rng(1)
    margins = rng.normal(0, 2, 4000)
    labels = (rng.random(4000) < linear.sigmoid(0.7 * margins - 0.4)).astype(float)
    slope, offset = linear.calibrate(margins, labels)
    assert abs(slope - 0.7) < 0.1 and abs(offset + 0.4) < 0.15


def plain_co_training(texts, metadata, labels, rounds, confident, per_round):
    """The exchange told one row at a time, on the same fits."""
    rows = [linear.sparse_row(linear.hashed_ngrams(t)) for t in texts]
    known = {i: float(y) for i, y in enumerate(labels) if y is not None}
    of_text, of_metadata = dict(known), dict(known)
    share = sum(known.values()) / len(known)
    unknown = [i for i in range(len(texts)) if i not in known]
    for turn in range(rounds + 1):
        weights, bias = linear.fit_text([rows[i] for i in of_text], np.array(list(of_text.values())))
        dense = linear.fit_dense(metadata[list(of_metadata)], np.array(list(of_metadata.values())))
        if turn == rounds:
            return weights, bias, dense
        told = {"text": {}, "metadata": {}}
        for i in unknown:
            told["text"][i] = float(linear.sigmoid(bias + weights[rows[i][0]] @ rows[i][1]))
            told["metadata"][i] = float(linear.sigmoid(metadata[i] @ dense[:-1] + dense[-1]))
        for teacher, learner in (("text", of_metadata), ("metadata", of_text)):
            for label in (1.0, 0.0):
                sure = {i: p if label else 1 - p for i, p in told[teacher].items()}
                room = int(per_round * len(unknown) * (share if label else 1 - share))
                for i in sorted(unknown, key=lambda i: -sure[i])[:room]:
                    if sure[i] >= confident:
                        learner[i] = label


def test_cotraining_equals_a_plain_version(table):
    rows = table("documents").orderBy("doc_id").collect()
    marks = {r.doc_id: int(r.quality > 0) for r in table("labels").collect()}
    texts = [r.text for r in rows]
    metadata = np.array([cotraining.metadata_row(r.text, r.lang, r.source, r.n_chars) for r in rows])
    labels = [marks.get(r.doc_id) if i % 3 else None for i, r in enumerate(rows)]
    assert 20 < sum(y is not None for y in labels) < len(rows) / 2
    mine = cotraining.co_train(texts, metadata, labels, 3, 0.7, 0.25)
    plain = plain_co_training(texts, metadata, labels, 3, 0.7, 0.25)
    for a, b in zip(mine, plain, strict=True):
        assert np.allclose(a, b, atol=1e-4)
    alone = cotraining.co_train(texts, metadata, labels, 0, 0.7, 0.25)
    assert not np.allclose(mine[2], alone[2], atol=1e-3)  # labels were exchanged
