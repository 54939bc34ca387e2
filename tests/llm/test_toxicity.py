"""The positive-unlabelled learner: its gradient by differences, a known risk, held-out accuracy, and odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from episodica.llm import toxicity as T

MARKS = ["vilo", "brakut", "scorno"]


def corpus(n, seed=3, share=0.12, labelled=0.5):
    """Texts of invented words; toxic ones hold two to six words that begin with a mark. Half are labelled."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.choice([5, 40, 200]))]
        toxic = r.random() < share
        for _ in range(r.randint(2, 6) if toxic else 0):
            text.insert(r.randint(0, len(text)), r.choice(MARKS) + r.choice(["", "s", "ta", "mente", "no"]))
        docs.append((i, " ".join(text)))
        if r.random() < labelled:
            labels.append((i, int(toxic)))
    return docs, labels, {i: any(w.startswith(m) for w in t.split() for m in MARKS) for i, t in docs}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_toxic_texts_are_told_apart(spark):
    docs, labels, truth = corpus(6000)
    model = T.fit_model(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    mine = [(i, t) for i, t in docs if held(i)]
    score = model.scores([t for _, t in mine])
    toxic = np.array([truth[i] for i, _ in mine])
    assert toxic.sum() > 80
    assert (score[toxic] >= 0.5).mean() >= 0.95 and (score[~toxic] >= 0.5).mean() <= 0.01
    order = np.argsort(np.argsort(score))
    assert (order[toxic].mean() - (toxic.sum() - 1) / 2) / (~toxic).sum() >= 0.99


def test_only_training_labels_and_only_positives_teach(spark):
    """Other labels of held-out rows, and other texts of them, leave the model as it is; so do the zeros but for the prior."""
    docs, labels, _ = corpus(1500)
    frame = lambda d, y: (spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int"))
    fit = T.Fit(prior=0.12)
    model = T.fit_model(*frame(docs, labels), fit=fit)
    assert T.fit_model(*frame(docs, [(i, 1 - y if held(i) else y) for i, y in labels]), fit=fit) == model
    assert T.fit_model(*frame([(i, "" if held(i) else t) for i, t in docs], labels), fit=fit) == model
    assert T.fit_model(*frame(docs, [(i, y) for i, y in labels if y]), fit=fit) == model


def test_the_risk_falls_and_its_negative_part_stays_whole():
    """Few positives and many features: the plain unbiased estimate goes far below zero, the corrected one doesn't."""
    r = np.random.default_rng(1)
    rows = lambda n, toxic: [sorted({*r.choice(400, 12, replace=False).tolist(), *([400] if x else [])}) for x in toxic[:n]]
    positive, unlabelled = rows(40, [True] * 40), rows(300, (r.random(300) < 0.2).tolist())

    def negative_risk(fit):
        w, b = T.fit_nnpu(positive, unlabelled, 401, 0.2, fit)
        score = lambda xs: np.array([b + w[x].sum() for x in xs])
        return np.logaddexp(0, score(unlabelled)).mean() - 0.2 * np.logaddexp(0, score(positive)).mean(), w

    corrected, w = negative_risk(T.Fit(decay=0.0))
    plain, _ = negative_risk(T.Fit(decay=0.0, slack=np.inf))
    assert plain < -0.05 < -0.02 < corrected
    assert w[400] > np.quantile(w, 0.75)
    assert np.array_equal(T.fit_nnpu([], unlabelled, 401, 0.2)[0], np.zeros(401))


def test_rows_are_taken_with_their_places():
    rows = T.Rows([[3, 5], [], [1], [0, 2, 4]])
    features, row = rows.take(np.array([3, 1, 0, 3]))
    assert features.tolist() == [0, 2, 4, 3, 5, 0, 2, 4] and row.tolist() == [0, 0, 0, 2, 2, 3, 3, 3]


def test_odd_rows(spark, tmp_path):
    docs, labels, _ = corpus(800)
    odd = [(None, None), (None, "vilo vilos"), (1, ""), (1, "vilo"), (1, "vilo"), (900, "x" * 200_000), (901, "vilo vilos brakut scornono brakutta " * 10_000), (902, None)]
    spark.createDataFrame([(i, t, 0.0, 1) for i, t in docs + odd], "doc_id long, text string, score double, toxic int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (1, 1), (1, 0), (None, 1), (902, 1), (5, None), (10**9, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = T.op12_nnpu_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + len(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[900] == score[902] < 0.5 < score[901]


@pytest.mark.parametrize("n_docs,n_labels", [(0, 0), (30, 0), (0, 30), (30, 30)])
def test_small_and_empty_tables(spark, n_docs, n_labels):
    docs, labels, _ = corpus(30)
    d, y = spark.createDataFrame(docs[:n_docs], "doc_id long, text string"), spark.createDataFrame(labels[:n_labels], "doc_id long, toxic int")
    assert T.score_toxicity(d, T.fit_model(d, y)).count() == n_docs
