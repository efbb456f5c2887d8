"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their first four and five bytes (inflected
insults share a stem), hashed to ``BUCKETS`` places. Each document has the set
of its terms; the machine adds a weight for each and an inner product of
factors for each pair, so that a pair such as insult and group mention can
count for more than both alone. Weights and factors are learned by Adam steps
with soft thresholds on at most ``SAMPLE_ROWS`` labelled rows a class; terms of
under ``MIN_ROWS`` sampled documents have none. The model has a fixed size and
goes to all executors.

Cases: null and empty texts score the intercept; unlabelled tables give a
constant 0.5; repeated rows score alike; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.llm.sampling import held_out, labelled, prior_shift
from sparsewright.llm.vec import ALNUM, LOWER, U64, Slice, mix, prefix_hash, slices, span_hash, texts_of

BUCKETS = 1 << 18
FACTORS = 4
SAMPLE_ROWS = 2500
MIN_ROWS = 5
#: Of selection, and of fitting what was selected.
ROUNDS = (80, 120)
STEMS = (4, 5)


def terms(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first): the distinct buckets of each text, in order, and their offsets."""
    held = Slice(texts)
    begin, end, first = held.words(ALNUM)
    sums = prefix_hash(LOWER[held.buf])
    doc = np.repeat(np.arange(held.n, dtype=np.int64), np.diff(first))
    all_terms, all_docs = [span_hash(sums, begin, end)], [doc]
    for k in STEMS:
        long = end - begin > k
        all_terms.append(mix(span_hash(sums, begin[long], begin[long] + k) + U64(k)))
        all_docs.append(doc[long])
    bucket = (np.concatenate(all_terms) % U64(buckets)).astype(np.int64)
    pair = np.unique(np.concatenate(all_docs) * buckets + bucket)
    return pair % buckets, np.append(np.searchsorted(pair, np.arange(held.n) * buckets), len(pair))


@dataclass
class Machine:
    intercept: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums over each document's terms; only terms with parameters are gathered."""
        used = np.flatnonzero(self.weight[bucket] != 0) if not self.factor.any() else np.flatnonzero((self.weight[bucket] != 0) | self.live[bucket])
        doc = np.searchsorted(first, used, side="right") - 1
        b, n = bucket[used], len(first) - 1
        out = self.intercept + np.bincount(doc, weights=self.weight[b], minlength=n)
        for f in range(self.factor.shape[1]):
            v = self.factor[b, f].astype(np.float64)
            s = np.bincount(doc, weights=v, minlength=n)
            out += 0.5 * (s * s - np.bincount(doc, weights=v * v, minlength=n))
        return out

    def __post_init__(self):
        self.live = self.factor.any(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _descend(doc: np.ndarray, col: np.ndarray, label: np.ndarray, w: np.ndarray, v: np.ndarray, b0: float, rounds: int, l1: float, l2: float, rate: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Adam steps on the logistic loss over (document, term) pairs, each followed by a soft threshold of ``l1``."""
    n, m, factors = len(label), len(w), len(v)
    first, second = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    for step in range(1, rounds + 1):
        sums = [np.bincount(doc, weights=v[f][col], minlength=n) for f in range(factors)]
        logit = b0 + np.bincount(doc, weights=(w - 0.5 * (v * v).sum(axis=0))[col], minlength=n)
        for s in sums:
            logit = logit + 0.5 * s * s
        error = (sigmoid(logit) - label) / n
        through = np.bincount(col, weights=error[doc], minlength=m)
        pair = np.stack([np.bincount(col, weights=(error * sums[f])[doc], minlength=m) for f in range(factors)])
        moved = []
        for k, (x, g, scale) in enumerate(((w, through + l2 * w, rate), (v, pair - v * through + l2 * v, 0.3 * rate), (np.float64(b0), error.sum(), rate))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            size = scale / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-5)
            x = x - size * first[k] / (1 - 0.9**step)
            moved.append(x if k == 2 else np.sign(x) * np.maximum(0, np.abs(x) - size * l1))
        w, v, b0 = moved[0], moved[1], float(moved[2])
    return w, v, b0


def fit(bucket: np.ndarray, first: np.ndarray, label: np.ndarray, shift: float = 0.0, buckets: int = BUCKETS, factors: int = FACTORS, min_rows: int = MIN_ROWS, l1: float = 3e-3, rounds: tuple[int, int] = ROUNDS) -> Machine:
    """Learn from documents' term sets (``bucket``, ``first``) and 0/1 labels; ``shift`` corrects the intercept for the sampling.

    The first rounds select terms with the soft threshold; the others fit the selected terms without it.
    """
    weight, factor = np.zeros(buckets, dtype=np.float32), np.zeros((buckets, factors), dtype=np.float32)
    if not len(label) or label.min() == label.max():
        return Machine(0.0, weight, factor)
    live = np.bincount(bucket, minlength=buckets) >= min_rows
    of = np.repeat(np.arange(len(label)), np.diff(first))
    w, v, b0 = np.zeros(int(live.sum())), np.random.default_rng(7).normal(0, 0.02, (factors, int(live.sum()))), 0.0
    for turn, (count, threshold) in enumerate(zip(rounds, (l1, 0.0), strict=True)):
        column = np.cumsum(live) - 1
        keep = live[bucket]
        w, v, b0 = _descend(of[keep], column[bucket[keep]], label, w, v, b0, count, threshold, 1e-4, 0.1)
        if not turn:
            some = (w != 0) | v.any(axis=0)
            live[live] = some
            w, v = w[some], v[:, some]
    weight[live] = w
    factor[live] = v.T
    return Machine(b0 + shift, weight, factor)


def _packed(batches):
    for batch in batches:
        for part in slices(batch):
            bucket, first = terms(texts_of(part.column(0)))
            rows = [bucket[first[i] : first[i + 1]].astype(np.int32).tobytes() for i in range(part.num_rows)]
            yield pa.record_batch([pa.array(rows, pa.binary()), part.column(1)], ["terms", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Learn from labelled rows whose remainder is not ``rest``; at most ``sample_rows`` of each class reach the driver, as term numbers."""
    rows, total = labelled(docs, labels, label, modulus, rest, sample_rows)
    got = rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(_packed, "terms binary, label int").toArrow()
    sets = [np.frombuffer(x, dtype=np.int32) for x in got.column(0).to_pylist()]
    y = got.column(1).to_numpy().astype(np.float64)
    order = np.array(sorted(range(len(y)), key=lambda i: (y[i], sets[i].tobytes())), dtype=np.int64)  # rows arrive in any order
    sets, y = [sets[i] for i in order], y[order]
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    bucket = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, dtype=np.int64)
    return fit(bucket, first, y, prior_shift(total, int(y.sum()), int(len(y) - y.sum())))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed number of buckets and factors
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                logit = held.value.logits(*terms(texts_of(part.column(1))))
                yield pa.record_batch([part.column(0), pa.array(sigmoid(logit))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels, "toxic", 3, 1))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
