"""Quality by a sparse rule ensemble over text statistics.

``STATISTICS`` are computed for every whole text. Small regression trees are
boosted on a bounded labelled sample; every node's path is a conjunctive rule;
a logistic regression with a lasso penalty keeps few of them; the survivors are
compiled into one Spark column expression over the statistics.

Cases: null and empty texts have all-zero statistics and a score like any
other; without labels of both classes the score is 0.5; repeated rows score
alike; an empty table gives an empty result; further columns are kept by
``with_statistics`` (its own are prefixed, and replace any of their names).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.llm.frames import packed, restored
from sparsewright.llm.sampling import held_out, labelled, prior_shift
from sparsewright.llm.vec import LEAD, NON_SPACE, U64, Slice, group_sum, mix, prefix_hash, slices, span_hash, table_of, texts_of

SAMPLE_ROWS = 4000
TREES, DEPTH, LEAF_ROWS = 16, 3, 20
KEPT = 0.7

STATISTICS = (
    "log_words",
    "word_length",
    "upper_share",
    "symbol_share",
    "exclamation_share",
    "digit_share",
    "stop_share",
    "same_as_previous",
    "distinct_share",
    "repeated_trigrams",
    "bare_words",
    "marked_words",
    "line_length",
    "repeated_lines",
    "top_word_share",
    "letter_share",
)
_UPPER = table_of(lambda b: 65 <= b <= 90)
_LETTER = table_of(lambda b: b >= 0x80 or chr(b).isalpha())
_SYMBOL = table_of(lambda b: b in b"#*$%&|<>@^~_=+/\\{}[]")
_DIGIT = table_of(lambda b: 48 <= b <= 57)
_STOP = table_of(lambda b: b in b".,;:?")
_BANG = table_of(lambda b: b == 33)
_ALNUM = table_of(lambda b: b >= 0x80 or chr(b).isalnum())


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    held = Slice(texts)
    begin, end, first = held.words(NON_SPACE)
    n_words = np.diff(first)
    words = np.maximum(n_words, 1)
    edges = np.append(held.at, len(held.buf))
    count = lambda member: group_sum(member[held.buf].astype(np.int64), edges)
    size = np.maximum(held.size, 1)
    h = span_hash(prefix_hash(held.buf), begin, end)
    doc = np.repeat(np.arange(held.n), n_words)
    salt = mix(np.arange(held.n, dtype=np.uint64) + U64(11))
    inner = np.ones(len(h), dtype=bool)
    inner[first[:-1][n_words > 0]] = False
    same = np.zeros(len(h), dtype=np.int64)
    same[1:] = (h[1:] == h[:-1]) & inner[1:]

    def distinct(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and the largest multiplicity, by document."""
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        new = np.append(True, k[1:] != k[:-1])[: len(k)]
        at = np.flatnonzero(new)
        mult, owner = np.diff(np.append(at, len(k))), of[order][at]
        most = np.zeros(held.n, dtype=np.int64)
        np.maximum.at(most, owner, mult)
        return np.bincount(owner, minlength=held.n), most

    n_distinct, top = distinct(mix(h ^ salt[doc]), doc)
    tri = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, dtype=np.int64)
    n_tri = np.bincount(doc[tri], minlength=held.n)
    tri_distinct, _ = distinct(mix(h[tri] + h[tri + 1] * U64(3) + h[tri + 2] * U64(9) ^ salt[doc[tri]]), doc[tri])
    letters = np.zeros(len(held.buf) + 1, dtype=np.int64)
    np.cumsum(_ALNUM[held.buf], out=letters[1:])
    bare = (letters[end] == letters[begin]).astype(np.int64)
    last = held.buf[end - 1]
    marked = (~_ALNUM[last] & ~_STOP[last]).astype(np.int64)
    close = np.flatnonzero(held.buf == 10)
    open_ = np.append(0, close[:-1] + 1)
    line_doc = np.searchsorted(held.at, open_, side="right") - 1
    full = close > open_
    lines = np.bincount(line_doc[full], minlength=held.n)
    line_distinct, _ = distinct(mix(span_hash(prefix_hash(held.buf), open_[full], close[full]) ^ salt[line_doc[full]]), line_doc[full])
    characters = count(LEAD) - 1
    out = [
        np.log1p(n_words),
        group_sum((end - begin).astype(np.int64), first) / words,
        count(_UPPER) / np.maximum(count(_LETTER), 1),
        count(_SYMBOL) / size,
        count(_BANG) / words,
        count(_DIGIT) / size,
        count(_STOP) / words,
        group_sum(same, first) / words,
        n_distinct / words,
        (n_tri - tri_distinct) / np.maximum(n_tri, 1),
        group_sum(bare, first) / words,
        group_sum(marked, first) / words,
        np.log1p(np.maximum(characters, 0) / np.maximum(lines, 1)),
        (lines - line_distinct) / np.maximum(lines, 1),
        top / words * (n_words >= 20),
        count(_LETTER) / size,
    ]
    return np.column_stack([np.asarray(x, dtype=np.float64) for x in out]).reshape(held.n, len(STATISTICS))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``stat_<name>`` for each statistic."""
    docs = docs.drop(*(f"stat_{s}" for s in STATISTICS))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = statistics(texts_of(part.column(at)))
                yield pa.record_batch([*part.columns, *(pa.array(np.ascontiguousarray(found[:, j])) for j in range(found.shape[1]))], [*part.schema.names, *(f"stat_{s}" for s in STATISTICS)])

    return docs.mapInArrow(run, kept + "".join(f", stat_{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): > if above, else <=."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for j, above, t in self.tests:
            out &= (x[:, j] > t) if above else (x[:, j] <= t)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for j, above, t in self.tests:
            c = F.col(f"stat_{STATISTICS[j]}")
            out = out & ((c > t) if above else (c <= t))
        return out


def _grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, tests: tuple, depth: int, rules: list, fitted: np.ndarray, columns: np.ndarray) -> None:
    """Split ``rows`` where the residual's squares fall most; the leaves' means go to ``fitted``."""
    if tests:
        rules.append(Rule(tests))
    best = (1e-9, -1, 0.0)
    if depth and len(rows) >= 2 * LEAF_ROWS:
        total, n = residual[rows].sum(), len(rows)
        for j in columns:
            order = np.argsort(x[rows, j], kind="stable")
            v, s = x[rows[order], j], np.cumsum(residual[rows[order]])
            left = np.arange(1, n)
            gain = s[:-1] ** 2 / left + (total - s[:-1]) ** 2 / (n - left) - total**2 / n
            gain[(v[1:] <= v[:-1]) | (left < LEAF_ROWS) | (n - left < LEAF_ROWS)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(j), float((v[k] + v[k + 1]) / 2))
    if best[1] < 0:
        fitted[rows] = residual[rows].mean()
        return
    above = x[rows, best[1]] > best[2]
    for side in (False, True):
        _grow(x, residual, rows[above == side], (*tests, (best[1], side, best[2])), depth - 1, rules, fitted, columns)


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Paths of boosted trees, each on a random half of the statistics."""
    rng, rules, logit = np.random.default_rng(5), [], np.zeros(len(y))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-logit))
        fitted = np.zeros(len(y))
        columns = np.sort(rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False))
        _grow(x, residual, np.arange(len(y)), (), depth, rules, fitted, columns)
        logit = logit + 2.0 * fitted
    return list(dict.fromkeys(rules))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps."""
    n, m = z.shape
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    w, b, u, c, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(z @ u + c))) - y) / n
        new = u - step * (z.T @ error)
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        new_b = c - step * error.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w, float(b)


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            logit += w * r.holds(x)
        return 1 / (1 + np.exp(-logit))

    def column(self) -> Column:
        """The score as one expression over the ``stat_`` columns."""
        logit = F.lit(self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            logit = logit + F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def fit(x: np.ndarray, y: np.ndarray, shift: float = 0.0, penalty: float = 1e-3) -> Ensemble:
    if not len(y) or y.min() == y.max():
        return Ensemble([], [], 0.0)
    rules = extract_rules(x, y)
    if not rules:
        return Ensemble([], [], shift)
    z = np.column_stack([r.holds(x) for r in rules]).astype(np.float64)
    w, b = lasso_logistic(z, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble([rules[k] for k in kept], [float(w[k]) for k in kept], b + shift)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Learn from at most ``sample_rows`` labelled rows a class, none of the held-out remainder."""
    rows, total = labelled(docs, labels, "quality", 4, 2, sample_rows)
    got = with_statistics(rows.select("doc_id", "text", F.col("label").cast("int").alias("label"))).drop("text", "doc_id").toArrow()
    y = got.column("label").to_numpy().astype(np.float64)
    x = np.column_stack([got.column(f"stat_{s}").to_numpy() for s in STATISTICS]) if len(y) else np.zeros((0, len(STATISTICS)))
    order = np.lexsort([*x.T, y]) if len(y) else np.zeros(0, dtype=np.int64)  # rows arrive in any order
    x, y = x[order], y[order]
    return fit(x, y, prior_shift(total, int(y.sum()), int(len(y) - y.sum())))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = with_statistics(docs.select("doc_id", "text")).withColumn("score", train(docs, labels).column())
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= KEPT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go. Labels come from the input folder's table."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restored(with_statistics(packed(docs)).filter(model.column() >= KEPT), docs)
