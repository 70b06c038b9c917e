import random
from zlib import crc32

import numpy as np
import pytest

from bazaar.llm import quality, toxicity


@pytest.fixture(scope="module")
def made(spark):
    random.seed(3)
    syllables = ["ta", "re", "mi", "sol", "ko", "lun", "per", "da", "vi"]

    def word():
        return "".join(random.choice(syllables) for _ in range(random.randint(1, 4)))

    rows, labels = [], []
    for i in range(700):
        words = [word() for _ in range(random.randint(30, 120))]
        toxic, good = int(random.random() < 0.2), int(random.random() < 0.8)
        if toxic:
            for _ in range(4):
                words.insert(random.randrange(len(words)), random.choice(["grumpf", "zorkel", "blimmo"]) + random.choice(["", word()]))
        text = " ".join(words) + "." if good else "!! ".join(words).upper() + "!!"
        rows.append((i, text))
        labels.append((i, good, toxic))
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
            {i: (q, t) for i, q, t in labels})


def auc(scored):
    ones, zeros = [s for s, y in scored if y], [s for s, y in scored if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


@pytest.mark.parametrize("which", [0, 1])
def test_held_out_accuracy_and_determinism(made, which):
    documents, labels, truth = made
    run = (quality.quality_scores, toxicity.toxicity_scores)[which]
    rows = run(documents, labels).collect()
    assert len(rows) == 700
    remainder, modulus = ((1, 3), (2, 4))[which]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % modulus == remainder) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5, 0.3)[which]) for r in rows)
    assert auc([(r.score, truth[r.doc_id][which]) for r in rows if r.held_out]) > 0.97
    again = {r.doc_id: r.score for r in run(documents.repartition(5), labels.repartition(3)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_held_out_labels_do_not_matter(made, spark):
    documents, labels, _ = made
    for run, module, column in ((quality.quality_scores, quality, "quality"), (toxicity.toxicity_scores, toxicity, "toxic")):
        import pyspark.sql.functions as F
        flipped = labels.withColumn(column, F.when(module.held_out(F.col("doc_id")), 1 - F.col(column)).otherwise(F.col(column)))
        some = documents.where("doc_id < 60")
        a = {r.doc_id: r.score for r in run(documents, labels).join(some.select("doc_id"), "doc_id").collect()}
        b = {r.doc_id: r.score for r in run(documents, flipped).join(some.select("doc_id"), "doc_id").collect()}
        assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for run in (quality.quality_scores, toxicity.toxicity_scores):
        rows = run(odd, labels).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 1}) == 1
        assert run(nothing, labels).collect() == []
        assert len(run(odd, labels.limit(0)).collect()) == 9


def test_accepted_keeps_columns(made, odd):
    documents, labels, truth = made
    kept = quality.accepted(documents.withColumn("_score", documents.doc_id), labels)
    assert kept.columns == ["doc_id", "text", "_score"]
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids ^ {i for i, (q, _) in truth.items() if q}) < 20


def test_ftrl_learns_sparse_weights():
    model, draw = toxicity.Ftrl(), np.random.default_rng(0)
    for _ in range(3000):
        x = np.unique(draw.integers(10, 5000, 20))
        y = int(draw.random() < 0.5)
        model.learn(np.r_[x, 3] if y else x, y)
    w = model.weights(np.arange(5000))
    assert w[3] > 1 and (w != 0).mean() < 0.2


def test_negative_risk_is_kept_from_going_below_zero():
    draw = np.random.default_rng(0)
    good, bad = draw.normal(1, 1, (400, quality.WIDTH)), draw.normal(-1, 1, (400, quality.WIDTH))
    unlabelled = np.vstack([good[200:], bad[:200]])
    for prior in (0.5, None):
        model = quality.fit(good[:200], unlabelled, prior, epochs=20)
        score = quality.expanded(np.vstack([good, bad]), model["mean"], model["std"]) @ model["w"]
        assert auc(list(zip(score, [1] * 400 + [0] * 400))) > 0.97
