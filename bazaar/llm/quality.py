"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled 1 in the training part; everything else is
unlabelled web text, whatever its label says.  With the class prior p, the unbiased risk
of a scorer f is  p R(P, +) + [R(U, -) - p R(P, -)];  the bracket estimates the risk on
negatives and is kept from going below zero: where it would, the step goes the other way
(non-negative risk).  The loss is the sigmoid loss, f is linear in standardised text
statistics, their squares and the products of a few of them.

* The prior is the share of 1 among the training labels.  If they hold no 0, it is
  estimated from a positive-against-unlabelled fit: mean score of U over mean score of P.
* Training uses a bounded sample in the order of id hashes, ``MAX_POSITIVES`` and
  ``MAX_UNLABELLED`` rows at most; only their statistics (some 80 numbers a row) reach the driver.
* Statistics and scores are computed over every whole text.

Neither labels nor lang, source and doc_id are inputs of a score.  Null and empty texts
have the statistics of an empty text and get a score like others.  A doc_id that is
labelled both 0 and 1, or null, is not trained on.  Repeated rows are scored alike.  Without any
positive label every score is 0.5.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import crc_of_id, fresh, in_batches

MAX_POSITIVES = 12_000
MAX_UNLABELLED = 24_000
THRESHOLD = 0.5
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
_SENTENCE_END = re.compile(r"[.!?]+(?:\s|$)")


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe the whole text; all but the lengths are shares or means."""
    text = text or ""
    raw = text.encode()
    n = max(len(raw), 1)
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    top = sorted(counts.values(), reverse=True)[:10]
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    ends = len(_SENTENCE_END.findall(text))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), np.log1p(lengths.max()),
        lengths.mean(), lengths.std(), of[65:91].sum() / n, of[97:123].sum() / n, of[48:58].sum() / n, of[128:].sum() / n,
        (of[9:14].sum() + of[32]) / n, (of[:9].sum() + of[14:32].sum()) / n, len(counts) / m, (top or [0])[0] / m, sum(top) / m,
        sum(v for v in counts.values() if v > 1) / m, same / max(m - 1, 1), pairs / max(m - 1, 1),
        1 - len(set(lines)) / max(len(lines), 1), ends / m, min(m / max(ends, 1), 200.0),
        sum(map(str.isupper, words)) / m, sum(map(str.isalpha, words)) / m, sum(map(str.istitle, words)) / m,
        *(of[_PUNCTUATION] / n)])


WIDTH = len(statistics(""))
_CROSSED = [0, 1, 4, 6, 10, 12, 14, 16, 18, 19, 21, 22]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id, which has no label."""
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(False))


def expanded(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / std, -6, 6)
    crossed = [z[:, i] * z[:, j] for n, i in enumerate(_CROSSED) for j in _CROSSED[:n]]
    return np.column_stack([np.ones(len(z)), z, z * z / 4, np.column_stack(crossed) / 4])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = 30, rate: float = 0.01,
        seed: int = 7) -> dict:
    """Weights of the scorer; rows are ``statistics``."""
    both = np.vstack([positives, unlabelled])
    mean, std = both.mean(0), both.std(0) + 1e-6
    p, u = expanded(positives, mean, std), expanded(unlabelled, mean, std)
    if prior is None:
        prior = _estimated_prior(p, u, seed)
    draw = np.random.default_rng(seed)
    w, first, second = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    batches, step = max(1, len(both) // 1024), 0
    for _ in range(epochs):
        for ip, iu in zip(np.array_split(draw.permutation(len(p)), batches), np.array_split(draw.permutation(len(u)), batches)):
            if not len(ip) or not len(iu):
                continue
            sp, su = _sigmoid(p[ip] @ w), _sigmoid(u[iu] @ w)
            slope_p, slope_u = p[ip].T @ (sp * (1 - sp)) / len(ip), u[iu].T @ (su * (1 - su)) / len(iu)
            on_negatives = su.mean() - prior * sp.mean()  # the sigmoid loss of a negative is its score
            gradient = -prior * slope_p + (slope_u - prior * slope_p) if on_negatives >= 0 else prior * slope_p - slope_u
            step += 1
            gradient = gradient + 1e-5 * w
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient ** 2
            w = w - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return {"mean": mean, "std": std, "w": w, "prior": prior}


def _estimated_prior(p: np.ndarray, u: np.ndarray, seed: int) -> float:
    """Share of positives in ``u`` by a logistic fit of ``p`` against ``u``."""
    x, y, w = np.vstack([p, u]), np.r_[np.ones(len(p)), np.zeros(len(u))], np.zeros(p.shape[1])
    for _ in range(200):
        w -= 0.05 * (x.T @ (_sigmoid(x @ w) - y) / len(y) + 1e-4 * w)
    return float(np.clip(_sigmoid(u @ w).mean() / max(_sigmoid(p @ w).mean(), 1e-6), 0.05, 0.95))


def with_statistics(df: DataFrame) -> DataFrame:
    def each(batches):
        for batch in batches:
            rows = [statistics(x).tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return in_batches(df.select("doc_id", "text"), each, f"doc_id {dict(df.dtypes)['doc_id']}, x array<double>")


def train(documents: DataFrame, labels: DataFrame, prior: float | None = None) -> dict | None:
    """Fit on the training part; None if it has no positive."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    ones, n = known.agg(F.sum("hi"), F.count("*")).first()
    if not ones:
        return None
    if prior is None and ones < n:
        prior = ones / n
    by_hash = F.xxhash64("doc_id")
    trusted = known.where("hi = 1").select("doc_id").orderBy(by_hash).limit(MAX_POSITIVES)
    ids = documents.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    others = ids.orderBy(by_hash).limit(MAX_UNLABELLED)
    drawn = trusted.withColumn("trusted", F.lit(True)).unionByName(others.withColumn("trusted", F.lit(False)))
    wanted = drawn.groupBy("doc_id").agg(F.max("trusted").alias("is_p"), F.min("trusted").alias("only_p"))
    wanted = F.broadcast(wanted)  # MAX_POSITIVES + MAX_UNLABELLED ids at most
    rows = with_statistics(documents.select("doc_id", "text").join(wanted.select("doc_id"), "doc_id")).join(wanted, "doc_id")
    rows = rows.dropDuplicates(["doc_id"]).toPandas()
    if not len(rows) or not rows.is_p.any():
        return None
    x = np.array(rows.x.tolist())
    order = np.argsort(rows.doc_id.to_numpy(), kind="stable")
    x, is_p, is_u = x[order], rows.is_p.to_numpy(bool)[order], ~rows.only_p.to_numpy(bool)[order]
    return fit(x[is_p], x[is_u] if is_u.any() else x, prior)


def with_score(df: DataFrame, model: dict | None, column: str = "score") -> DataFrame:
    """``df`` with the score of the column ``text``."""
    keep = [f for f in df.schema.fields if f.name != column]
    at = [f.name for f in keep].index("text")

    def each(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            x = np.array([statistics(t) for t in texts]).reshape(-1, WIDTH)
            score = _sigmoid(expanded(x, model["mean"], model["std"]) @ model["w"]) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, column])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{column}` double"])
    return in_batches(df.select(*(F.col(f"`{f.name}`") for f in keep)), each, schema)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    scored = with_score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose predicted quality is 1, with the columns they came with."""
    score = fresh(documents, "_score")
    scored = with_score(documents, train(documents, labels), score)
    return scored.where(F.col(score) >= THRESHOLD).select(*(F.col(f"`{c}`") for c in documents.columns))
