"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, unused
from .textblocks import SPACE, Block, blocks, combine, mix, slice_hashes

#: Weights: one for each value of this many bits of a feature's hash.
BITS = 18
_PUNCTUATION, _WORD = 1, 2
_CLASS = np.full(256, _PUNCTUATION, np.uint8)
_CLASS[SPACE] = 0
for _range in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[slice(*_range)] = _WORD
_UPPER, _DIGIT = (np.zeros(256, np.int64) for _ in range(2))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each n-gram of each text, and the bounds of each text's features.

    Tokens are words and runs of punctuation. N-grams are of one and two tokens in lower case,
    and of one to three token shapes: the case of a word, digits, a repeat of the token before,
    or the punctuation itself.
    """
    data, n = block.data, len(block.data)
    kind = _CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[block.bounds] = edge[n] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= edge
    start = np.flatnonzero(change[:-1] & (kind > 0))
    end = np.flatnonzero(change[1:] & (kind > 0)) + 1
    lower = np.where(_UPPER[data] == 1, data + 32, data).astype(np.uint8)
    token = slice_hashes(lower, start, end)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    n_upper, n_digit, size = upper[end] - upper[start], digit[end] - digit[start], end - start
    shape = np.select([n_digit > 0, (n_upper > 1) & (2 * n_upper > size), n_upper > 0], [1, 2, 3], 4).astype(np.uint64)
    shape = np.where(kind[start] == _WORD, shape, token)
    same = np.zeros(len(token), bool)
    same[1:] = token[1:] == token[:-1]
    shape = mix(shape * np.uint64(2) + same)
    grams = [mix(token), combine(token, 2), mix(shape + np.uint64(7)), combine(shape, 2) ^ np.uint64(1), combine(shape, 3)]
    first = np.searchsorted(start, block.bounds)
    text = np.searchsorted(first, np.arange(len(token)), side="right") - 1
    last = first[text + 1] if len(token) else first[:0]
    out = []
    for g, width in zip(grams, (1, 2, 1, 2, 3), strict=True):
        inside = np.arange(len(g)) + width <= last[: len(g)]
        out.append((text[: len(g)][inside], (g[inside] >> np.uint64(64 - BITS)).astype(np.int64)))
    owner = np.concatenate([o for o, _ in out])
    order = np.argsort(owner, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(block.bounds) - 1))])
    return np.concatenate([f for _, f in out])[order], bounds


@dataclass
class Leader:
    """Follow-the-regularised-leader (proximal) with per-coordinate rates; the last weight is the bias."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        lean = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -lean / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: float, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = weight * (p - label) * x
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def _vector(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a text: shares of its features, times 10, and 1 for the bias."""
    at, n = np.unique(found, return_counts=True)
    return np.append(at, 1 << BITS), np.append(10 * n / max(len(found), 1), 1.0)


def held_out(doc_id) -> F.Column:
    """Whether a row's label is kept from training: crc32 of the id as text, modulo 3, is 1; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = 8_000, sample_bytes: int = 256 << 20, epochs: int = 4,
) -> np.ndarray:
    """Weights learned from at most ``sample_rows`` labelled rows outside the held-out third.

    The rows are those with the least hashes of their ids, so the sample is spread over the
    corpus and bounded at any size; one task learns from their whole texts, label classes
    weighted alike. In that order, a text that would bring the sample over ``sample_bytes`` of
    UTF-8 is skipped. Only ids, texts and labels are read. Null ids, texts and labels are skipped;
    an id with more than one label has the larger, and one with more than one text the text with
    the least hash. With nothing to learn from, all weights are 0.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("double").alias("label")).where(
        F.col("k").isNotNull() & F.col("label").isNotNull() & ~held_out("k")
    )
    known = known.groupBy("k").agg(F.max("label").alias("label"), F.xxhash64("k").alias("at"))
    sample = F.broadcast(known.orderBy("at", "k").limit(sample_rows))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    one = texts.join(sample, "k").groupBy("at", "k", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = one.select("at", "k", "t.text", "label").repartition(1).sortWithinPartitions("at", "k")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, goals, left = [], [], sample_bytes
        for batch in batches:
            labels_ = batch.column(3).to_pylist()
            for start, stop, block in blocks(batch.column(2)):
                found, bounds = features(block)
                for i in range(stop - start):
                    if (size := int(block.bounds[i + 1] - block.bounds[i])) > left:
                        continue
                    left -= size
                    goals.append(labels_[start + i])
                    at, x = _vector(found[bounds[i] : bounds[i + 1]])
                    vectors.append((at.astype(np.int32), x.astype(np.float32)))
        model, share = Leader(), np.mean(goals) if goals else 0.5
        for _ in range(epochs):
            for (at, x), goal in zip(vectors, goals, strict=True):
                model.learn(at, x, goal, 0.5 / max(share if goal else 1 - share, 1e-3))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().tobytes()])], ["weights"])

    made = rows.mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(made[0].weights) if made else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``quality_score``, the chance that a text's label is 1.

    The score is a sparse dot product of a text's n-gram shares with ``weights``, through the
    logistic function; it depends on the text alone. Null and empty texts get the bias's score;
    repeated rows each get theirs; an empty table stays empty; very long texts count whole; a
    column of the result's name is replaced.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(np.asarray(weights, np.float64))

    rows = docs.drop("quality_score")
    (held,) = unused(rows, "text_of_score")

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for start, stop, block in blocks(batch.column(batch.num_columns - 1)):
                found, bounds = features(block)
                some = np.flatnonzero(np.diff(bounds))
                if len(some):  # each text's own sum, whatever else is in the block
                    out[start + some] = np.add.reduceat(w[found], bounds[some]) * 10 / np.diff(bounds)[some]
            chance = 1 / (1 + np.exp(-np.clip(out + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(chance)], [*batch.schema.names[:-1], "quality_score"])

    schema = rows.limit(0).withColumn("quality_score", F.lit(0.0)).schema
    return rows.withColumn(held, docs[text_col]).mapInArrow(dots, schema)
