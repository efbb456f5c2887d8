"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents. Its words are mapped to the numbers of the
benchmark's words (any other word, and the end of a text, is a break), so only
runs of benchmark words that are long enough for some window are indexed. The
index has a suffix array sorted by prefix doubling, the Burrows-Wheeler
transform in a wavelet tree (one bit vector with rank counts a bit of the
symbol), and suffix positions sampled every ``SAMPLE`` places. All windows are
searched backwards at once, one word a round; their occurrences are located by
walking back to a sampled position, and the covered words are merged to spans.

A window is ``WINDOW`` consecutive words of an item; an item with fewer words,
but some, is one window. Benchmark items go to the executors in blocks of at
most ``BLOCK_WORDS`` words, so memory does not follow the benchmark; each block
is a pass. The first keeps every row; the others' spans are merged by the text's
SHA-256 and joined to the rows, as equal texts have equal hits.

Cases: null and empty texts have no words and no hits; items without words
match nothing; repeated items count once each by id, repeated rows of documents
and rows without an id or with a shared one keep one result each; an empty
benchmark or table gives zero hits or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.llm.frames import packed, restored
from sparsewright.llm.vec import ALNUM, LOWER, Slice, prefix_hash, slices, span_hash, texts_of

WINDOW = 8
BLOCK_WORDS = 1 << 20
SAMPLE = 16
MIN_ITEMS = 2


def word_hashes(texts: pa.Array) -> tuple[Slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slice, begin, end, first, hash) of the words of texts, A-Z lower-cased."""
    held = Slice(texts)
    begin, end, first = held.words(ALNUM)
    return held, begin, end, first, span_hash(prefix_hash(LOWER[held.buf]), begin, end)


@dataclass
class Windows:
    """Search patterns: rows of word numbers from 1 (0 pads the front of short ones), with the items that hold them."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    length: np.ndarray
    owner: np.ndarray
    item: np.ndarray
    items: list

    @classmethod
    def of(cls, items: list[tuple], window: int = WINDOW) -> Windows:
        """items: (id, text) pairs; windows that several items share are one pattern."""
        texts = texts_of(pa.array([t for _, t in items], pa.string()))
        _, _, _, first, h = word_hashes(texts)
        vocabulary = np.unique(h)
        number = np.searchsorted(vocabulary, h) + 1
        seen: dict[tuple, int] = {}
        owner, item = [], []
        for i in range(len(items)):
            words = number[first[i] : first[i + 1]]
            n = len(words)
            for j in range(max(1, n - window + 1) if n else 0):
                p = tuple(words[j : j + window])
                owner.append(seen.setdefault(p, len(seen)))
                item.append(i)
        patterns = np.zeros((len(seen), window), dtype=np.int64)
        for p, k in seen.items():
            patterns[k, window - len(p) :] = p
        pairs = np.unique(np.array([owner, item], dtype=np.int64).reshape(2, -1), axis=1)
        return cls(vocabulary, patterns, (patterns > 0).sum(axis=1), pairs[0], pairs[1], [i for i, _ in items])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.zeros(n, dtype=np.int64)
        fresh[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        if fresh[order[-1]] == n - 1 or k >= n:
            return order
        rank, k = fresh, 2 * k


class WaveletTree:
    """rank(symbol, place) over a sequence, one level of bits for each bit of the symbol."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = s >> b & 1
            ones = np.zeros(len(s) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        begin = np.zeros_like(place)
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros, strict=True):
            up = symbol >> b & 1 == 1
            begin = np.where(up, zeros + ones[begin], begin - ones[begin])
            place = np.where(up, zeros + ones[place], place - ones[place])
        return place - begin

    def access(self, place: np.ndarray) -> np.ndarray:
        """Symbols at places."""
        out = np.zeros_like(place)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            bit = ones[place + 1] - ones[place]
            out = out << 1 | bit
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
        return out


class FMIndex:
    """Of a sequence of positive numbers in which 0 is the break; the last symbol must be 0."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = SAMPLE):
        self.n = len(s)
        # breaks sort by place, below all words: no order is carried past a break
        breaks = np.cumsum(s == 0)
        order = suffix_array(np.where(s == 0, breaks, s + breaks[-1]))
        before = s[order - 1]
        self.bwt = WaveletTree(before, max(1, int(symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols + 1))])
        sampled = order % sample == 0
        self.ones = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(sampled, out=self.ones[1:])
        self.places = order[sampled]
        # the suffix that follows a break cannot be walked back from; sample it too
        edge = (before == 0) & ~sampled
        self.edge = dict(zip(np.flatnonzero(edge).tolist(), order[edge].tolist(), strict=True))
        self.edges = np.flatnonzero(edge)
        self.edge_places = order[edge]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of patterns (0 pads the front), one backward step a column."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((patterns[:, j] > 0) & (low < high))
            if not len(live):
                continue
            c = patterns[live, j]
            low[live] = self.first[c] + self.bwt.rank(c, low[live])
            high[live] = self.first[c] + self.bwt.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, dtype=np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            hit = self.ones[at + 1] > self.ones[at]
            out[live[hit]] = self.places[self.ones[at[hit]]] + steps
            live = live[~hit]
            at = rows[live]
            slot = np.searchsorted(self.edges, at)
            edge = np.zeros(len(at), dtype=bool)
            inside = slot < len(self.edges)
            edge[inside] = self.edges[slot[inside]] == at[inside]
            out[live[edge]] = self.edge_places[slot[edge]] + steps
            live = live[~edge]
            at = rows[live]
            c = self.bwt.access(at)
            rows[live] = self.first[c] + self.bwt.rank(c, at)
            steps += 1
        return out


def shard_hits(texts: pa.Array, windows: Windows) -> tuple[np.ndarray, list, list, list]:
    """Of each text: its number of words, begins and ends of its hit spans in words, and the positions of its items in ``windows.items``."""
    held, _, _, first, h = word_hashes(texts)
    n_words = np.diff(first)
    spans = [([], []) for _ in range(held.n)]
    found_items: list = [[] for _ in range(held.n)]
    if not len(h) or not len(windows.patterns):
        return n_words, [s[0] for s in spans], [s[1] for s in spans], found_items
    slot = np.searchsorted(windows.vocabulary, h)
    slot[slot == len(windows.vocabulary)] = 0
    number = np.where(windows.vocabulary[slot] == h, slot + 1, 0)
    # runs of benchmark words within a text, as long as the shortest window at least
    doc = np.repeat(np.arange(held.n), n_words)
    fresh = np.ones(len(number) + 1, dtype=bool)
    fresh[1:-1] = (doc[1:] != doc[:-1]) | (number[1:] == 0) | (number[:-1] == 0)
    edge = np.flatnonzero(fresh)
    begin, size = edge[:-1], np.diff(edge)
    keep = (number[begin] > 0) & (size >= windows.length.min())
    begin, size = begin[keep], size[keep]
    if not len(begin):
        return n_words, [s[0] for s in spans], [s[1] for s in spans], found_items
    total = int((size + 1).sum())
    s = np.zeros(total, dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    inner = np.arange(total) - np.repeat(at, size + 1)
    word = np.repeat(begin, size + 1) + inner
    real = inner < np.repeat(size, size + 1)
    s[real] = number[word[real]]
    index = FMIndex(s, len(windows.vocabulary))
    low, high = index.search(windows.patterns)
    counts = high - low
    pattern = np.repeat(np.arange(len(counts)), counts)
    if not len(pattern):
        return n_words, [x[0] for x in spans], [x[1] for x in spans], found_items
    rows = np.repeat(low, counts) + np.arange(len(pattern)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = word[index.locate(rows)]
    stop = start + windows.length[pattern]
    # merge: +1 at begins, -1 at ends
    cover = np.zeros(len(number) + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, stop, -1)
    hit = np.zeros(len(number) + 2, dtype=np.int8)
    hit[1:-1] = np.cumsum(cover)[:-1] > 0
    change = np.diff(hit)
    up, down = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # a span can touch the next text's: cut spans at text ends
    cuts = first[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(number))]
    cuts = np.unique(cuts[(hit[cuts] > 0) & (hit[cuts + 1] > 0)])
    up, down = np.sort(np.concatenate([up, cuts])), np.sort(np.concatenate([down, cuts]))
    of = doc[up]
    for d, a, b in zip(of.tolist(), (up - first[of]).tolist(), (down - first[of]).tolist(), strict=True):
        spans[d][0].append(a)
        spans[d][1].append(b)
    # items: patterns found in a text, and their owners
    pairs = np.unique(doc[start] * np.int64(len(counts)) + pattern)
    d, p = pairs // len(counts), pairs % len(counts)
    lo, hi = np.searchsorted(windows.owner, p), np.searchsorted(windows.owner, p, side="right")
    d = np.repeat(d, hi - lo)
    k = np.repeat(lo, hi - lo) + np.arange(len(d)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    both = np.unique(d * np.int64(len(windows.items)) + windows.item[k])
    for x in both.tolist():
        found_items[x // len(windows.items)].append(x % len(windows.items))
    return n_words, [x[0] for x in spans], [x[1] for x in spans], found_items


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """The benchmark's items in blocks of bounded size, read one block at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len((r.text or "").split()) + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block


def cut_words(text: str, begins: list, ends: list) -> str:
    """The text less the spans of words, each from its first word's begin to its last word's end."""
    raw = text.encode()
    begin, end, _ = Slice(pa.array([raw], pa.binary())).words(ALNUM)
    out, last = [], 0
    for b, e in zip(begins, ends, strict=True):
        out.append(raw[last : begin[b]])
        last = end[e - 1]
    return b"".join([*out, raw[last:]]).decode()


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """``docs`` with n_words, begins, ends (hit word spans, in order, disjoint) and item_ids (as text, sorted). With ``cut``, the text is left without the spans."""
    spark = docs.sparkSession
    docs = docs.drop("n_words", "begins", "ends", "item_ids")

    def search(docs: DataFrame, block: list[tuple], cut: bool = False) -> DataFrame:
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        at = docs.columns.index("text")
        held = spark.sparkContext.broadcast(Windows.of(block, window))

        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    n, begins, ends, items = shard_hits(texts_of(part.column(at)), held.value)
                    names = [sorted({str(held.value.items[i]) for i in x}) for x in items]
                    columns = list(part.columns)
                    if cut and any(begins):
                        texts = [cut_words(t, b, e) if b else t for t, b, e in zip(columns[at].to_pylist(), begins, ends, strict=True)]
                        columns[at] = pa.array(texts, part.schema.field(at).type)
                    yield pa.record_batch([*columns, pa.array(n, pa.int64()), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], [*part.schema.names, "n_words", "begins", "ends", "item_ids"])

        return docs.mapInArrow(run, f"{kept}, n_words long, begins array<long>, ends array<long>, item_ids array<string>")

    blocks = _blocks(benchmark, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return search(docs, first, cut)
    texts = docs.select("text")
    more = search(texts, second)
    for block in blocks:
        more = more.unionByName(search(texts, block))
    hits = more.filter(F.size("begins") > 0).groupBy(F.sha2("text", 256).alias("hit_key"))
    hits = hits.agg(F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("begins", "ends")))).alias("more_spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("more_items"))
    own = search(docs, first)
    rows = own.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "n_words", "begins", "ends", "item_ids", F.sha2("text", 256).alias("row_key"))
    rows = rows.join(hits, F.col("row_key") == F.col("hit_key"), "left")
    zipped = F.arrays_zip("begins", "ends")
    spans = F.array_sort(F.concat(zipped, F.coalesce("more_spans", F.array().cast("array<struct<begins:bigint,ends:bigint>>"))))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<begins:bigint,ends:bigint>>"),
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["ends"] >= s["begins"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["begins"].alias("begins"), F.greatest(F.element_at(out, -1)["ends"], s["ends"]).alias("ends"))))).otherwise(F.concat(out, F.array(F.struct(s["begins"].alias("begins"), s["ends"].alias("ends"))))),
    )
    items = F.array_sort(F.array_union("item_ids", F.coalesce("more_items", F.array().cast("array<string>"))))
    rows = rows.select("row", "n_words", spans.alias("spans"), items.alias("item_ids")).withColumn("spans", merged)
    merged = rows.select(*(F.col(f"row.`{c}`") for c in docs.columns), "n_words", F.col("spans")["begins"].alias("begins"), F.col("spans")["ends"].alias("ends"), "item_ids")
    return without_spans(merged) if cut else merged


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "begins", "ends", "item_ids")
    found = find_spans(docs, benchmark)
    n_hit = F.aggregate(F.zip_with("ends", "begins", lambda e, b: e - b), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(*docs.columns, "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("item_ids") >= MIN_ITEMS).alias("contaminated"))


def without_spans(found: DataFrame) -> DataFrame:
    """Rows of ``find_spans`` with ``text`` less its hit spans."""
    at, begins, ends = (found.columns.index(c) for c in ("text", "begins", "ends"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)

    def run(batches):
        for batch in batches:
            texts = [cut_words(t, b, e) if b else t for t, b, e in zip(*(batch.column(j).to_pylist() for j in (at, begins, ends)), strict=True)]
            columns = [pa.array(texts, batch.schema.field(at).type) if j == at else batch.column(j) for j in range(batch.num_columns)]
            yield pa.record_batch(columns, batch.schema.names)

    return found.mapInArrow(run, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go; any other loses its hit spans."""
    found = find_spans(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True)
    return restored(found.filter(F.size("item_ids") < MIN_ITEMS), docs, text_changed=True)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return verdicts(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


def sha256_items(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 6))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
