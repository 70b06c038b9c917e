"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, the stems that their first letters make
(``STEMS``), pairs of neighbouring words, and pairs that skip one or two words; case and
punctuation are dropped.
They are hashed to ``BITS`` bits.  FTRL-proximal keeps a rate for each coordinate, and its L1
term leaves most weights at zero, so that the model is a short list that is broadcast.

* Training passes ``EPOCHS`` times, in one task, over a bounded sample of the labelled
  training rows: by order of id hashes, ``MAX_TOXIC`` rows labelled 1 and ``MAX_CLEAN`` labelled 0.
  The bias is then moved by the log odds between the sample and all training labels.
* Scores are computed over every whole text.

Neither labels nor lang, source and doc_id are inputs of a score.  Null and empty texts have
no feature: their score is that of the bias.  A doc_id labelled both 0 and 1, or null, is not
trained on.  Repeated rows are scored alike.  Without labels of both kinds every score is
the share of toxic ones among them (0 without labels).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import crc_of_id, in_batches

BITS = 22
STEMS = (3, 4, 5, 6, 7)
MAX_TOXIC = 6_000
MAX_CLEAN = 9_000
EPOCHS = 3
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.1, 1.0, 2.0, 1.0

_WORD = re.compile(r"\w+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_KNOWN_WORDS = 500_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id, which has no label."""
    return F.coalesce(crc_of_id(doc_id) % 4 == 2, F.lit(False))


class Features:
    """Hashed features of a text; word hashes are remembered, up to a bound."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = _WORD.findall((text or "").lower())
        if not words:
            return np.empty(0, np.uint32)
        if len(self.known) > _KNOWN_WORDS:
            self.known.clear()
        known = self.known
        distinct = list(set(words))
        for w in distinct:
            if w not in known:
                known[w] = (xxhash.xxh64_intdigest(w), *(xxhash.xxh64_intdigest(w[:n], 1) for n in STEMS))
        alone = np.array([known[w] for w in distinct], np.uint64).ravel()
        h = np.fromiter((known[w][0] for w in words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            skips = [(h[:-gap] * _ODD[gap - 1] + (h[gap:] ^ _ODD[3])) * _ODD[0] for gap in (1, 2, 3)]
            every = np.concatenate([alone * _ODD[0], *skips])
        return np.unique(every >> np.uint64(64 - BITS)).astype(np.uint32)


class Ftrl:
    """FTRL-proximal for binary features; the last coordinate is the bias, which is not regularised."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, 1 << BITS).astype(np.int64)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(documents: DataFrame, labels: DataFrame) -> dict:
    """{"at", "w", "bias"}: coordinates with a weight, in order, their weights, and the bias."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("hi")).where("toxic = hi").drop("hi")
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    nothing = {"at": np.empty(0, np.uint32), "w": np.empty(0)}
    if not toxic or not clean:
        return nothing | {"bias": 40.0 if toxic else -40.0}
    by_hash = F.xxhash64("doc_id")
    drawn = known.where("toxic = 1").orderBy(by_hash).limit(MAX_TOXIC) \
        .unionByName(known.where("toxic = 0").orderBy(by_hash).limit(MAX_CLEAN))
    sample = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # MAX_TOXIC + MAX_CLEAN ids at most

    def each(batches):
        features, rows = Features(), {}
        for batch in batches:
            for doc_id, text, label in zip(*(c.to_pylist() for c in batch.columns)):
                rows[doc_id] = (features(text), label)
        order = sorted(rows)
        model, draw = Ftrl(), np.random.default_rng(11)
        for _ in range(EPOCHS):
            for i in draw.permutation(len(order)):
                model.learn(*rows[order[i]])
        every = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(every)
        ones = sum(label for _, label in rows.values())
        yield pa.RecordBatch.from_pydict({
            "at": pa.array([*at, 1 << BITS, (1 << BITS) + 1], pa.int64()),
            "w": pa.array([*every[at], 0.0, np.log(max(ones, 1) / max(len(rows) - ones, 1))], pa.float64())})

    found = in_batches(sample.select("doc_id", "text", "toxic").repartition(1), each, "at long, w double").toPandas()
    at, w = found["at"].to_numpy(), found["w"].to_numpy()
    bias = w[at == 1 << BITS].sum() + np.log(toxic / clean) - w[at == (1 << BITS) + 1].sum()
    own = at < 1 << BITS
    return {"at": at[own].astype(np.uint32), "w": w[own], "bias": float(bias)}


def with_score(df: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``df`` with the score of the column ``text``."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in df.schema.fields if f.name != column]
    at = [f.name for f in keep].index("text")

    def each(batches):
        weights, features = np.zeros(1 << BITS, np.float32), Features()
        weights[sent.value["at"]] = sent.value["w"]
        for batch in batches:
            total = np.array([weights[features(x)].sum(dtype=np.float64) for x in batch.column(at).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(total + sent.value["bias"], -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())],
                                             names=[*batch.schema.names, column])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{column}` double"])
    return in_batches(df.select(*(F.col(f"`{f.name}`") for f in keep)), each, schema)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    scored = with_score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
