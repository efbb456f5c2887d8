"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words are hashed to ``BUCKETS`` places. Two
multinomials over the buckets are compared: the trusted target (labelled good
documents that pass the base rules) and the raw corpus (every document). A
document's verdict is the mean over its n-grams of log p_target - log p_raw,
held against a fixed threshold: no sampling of documents, so the same text
always gets the same verdict.

Both counts cover all their documents: each task adds its documents up to one
row a bucket, and only a row a bucket reaches the driver. Texts meet the ids of
the labelled good documents packed, in a join that broadcasts neither side.

Cases: null and empty texts have no words and fail the base rule on the number
of words; a table without labels has a flat ratio of 0, which keeps what passes
the base rules; repeated rows are judged alike; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.llm.vec import LEAD, NON_SPACE, SLICE, U64, Slice, group_sum, mix, prefix_hash, slices, span_hash, table_of, texts_of

BUCKETS = 1 << 16
#: Nats a n-gram; documents below go.
THRESHOLD = -0.35
WINDOW = 5
SMOOTHING = 1.0
_SYMBOL = table_of(lambda b: b in b"#*$%&|<>")


class Measured:
    """Base counts of each text, and its n-gram buckets."""

    def __init__(self, texts: pa.Array):
        held = Slice(texts)
        begin, end, first = held.words(NON_SPACE)
        self.n = held.n
        self.n_words = np.diff(first)
        lead = np.zeros(len(held.buf) + 1, dtype=np.int64)
        np.cumsum(LEAD[held.buf], out=lead[1:])
        self.word_chars = group_sum(lead[end] - lead[begin], first)
        edges = np.append(held.at, len(held.buf))
        self.n_symbols = group_sum(_SYMBOL[held.buf].astype(np.int64), edges)
        sums = prefix_hash(held.buf)
        h = span_hash(sums, begin, end)
        doc = np.repeat(np.arange(held.n), self.n_words)
        salt = mix(np.arange(held.n, dtype=np.uint64) + U64(23))
        self.n_repeat_words = self._repeats(h, doc, salt)
        self.n_dup_lines = self._lines(held, begin, sums, salt)
        # n-grams: words, then pairs within a text
        pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, dtype=np.int64)
        grams = np.concatenate([h, mix(h[pair] * U64(5) + h[pair + 1])])
        self.bucket = (grams % U64(BUCKETS)).astype(np.int64)
        self.owner = np.concatenate([doc, doc[pair]])
        self.base_failed = (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)

    def _repeats(self, h: np.ndarray, doc: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Words inside windows that occur twice or more in their text."""
        if len(h) < WINDOW:
            return np.zeros(self.n, dtype=np.int64)
        at = np.flatnonzero(doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1])
        key = salt[doc[at]]
        for k in range(WINDOW):
            key = mix(key * U64(3) + h[at + k])
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        return np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=self.n)

    def _lines(self, held: Slice, begin: np.ndarray, sums: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        close = np.flatnonzero(held.buf == 10)
        open_ = np.append(0, close[:-1] + 1)
        slot = np.searchsorted(begin, open_)
        full = np.append(begin, len(held.buf))[slot] < close
        open_, close = open_[full], close[full]
        doc = np.searchsorted(held.at, open_, side="right") - 1
        key = mix(span_hash(sums, open_, close) ^ salt[doc])
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), dtype=bool)
        again[order[1:]] = key[order][1:] == key[order][:-1]
        return np.bincount(doc[again], minlength=self.n)


def _counts(batches):
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for part in slices(batch):
            total += np.bincount(Measured(texts_of(part.column(0))).bucket, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])


def _pack(batches):
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch):
            yield pa.record_batch([part.column(0), pa.array([packer.compress(x.as_py()) for x in texts_of(part.column(1))], pa.binary())], ["doc_id", "packed"])


def _good_counts(batches):
    total = np.zeros(BUCKETS, dtype=np.int64)
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        held, size = [], 0
        for i, x in enumerate(batch.column(0), 1):
            held.append(unpack(x.as_py()))
            size += len(held[-1])
            if size < SLICE and i < batch.num_rows:
                continue
            m = Measured(pa.array(held, pa.binary()))
            held, size = [], 0
            total += np.bincount(m.bucket[~m.base_failed[m.owner]], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])


def _multinomial(rows: DataFrame, each) -> np.ndarray:
    """Log-probabilities of the buckets, smoothed."""
    counts = np.zeros(BUCKETS)
    for r in rows.mapInArrow(each, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS))


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target - log p_raw by bucket."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    if good.isEmpty():
        return np.zeros(BUCKETS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    target = known.mapInArrow(_pack, f"doc_id {kind}, packed binary").join(good.hint("merge"), "doc_id", "left_semi")
    return _multinomial(target.select("packed"), _good_counts) - _multinomial(docs.select("text"), _counts)


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr)."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                m = Measured(texts_of(part.column(1)))
                n_grams = np.bincount(m.owner, minlength=m.n)
                llr = np.bincount(m.owner, weights=held.value[m.bucket], minlength=m.n) / np.maximum(n_grams, 1)
                kept = ~m.base_failed & (llr >= threshold)
                yield pa.record_batch([part.column(0), *(pa.array(getattr(m, n).astype(np.int64)) for n in names), pa.array(m.base_failed), pa.array(kept), pa.array(llr)], ["doc_id", *names, "base_failed", "kept", "llr"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, llr double")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, train(docs, labels))
