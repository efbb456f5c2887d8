"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

``LineStore`` keeps, for every line key, the number of documents that hold it
(the exact reference-count table, a written table dealt by key) and, for each
shard of keys, a cuckoo filter of the keys that have reached the removal
threshold. Inserting documents adds to the counts and deleting them subtracts;
keys that cross the threshold enter or leave their shard's filter, which a
Bloom filter could not undo. Documents probe the filters first; only the lines
that they let through meet the exact table, so a false positive never drops a
line. A key is stored as its 128-bit digest.

Cases: a null text is an empty text and has one empty line; a line without any
character beside white space has an empty key and always stays; repeated rows
are documents of their own; null ids are kept as they are; an empty table gives
an empty result; further columns are kept, but for those named like the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.llm.frames import packed, restored
from sparsewright.llm.store import cut
from sparsewright.llm.vec import SPACE, slices, texts_of

MIN_DOCS = 10
#: Keys a filter shard is sized for; the number of shards follows the number of keys.
SHARD_KEYS = 200_000
#: Filters go to all executors only up to this many bytes; beyond it lines go to the filters, by shard.
FILTER_BYTES = 64 << 20
#: Lines that meet one copy of a filter there.
SALT_LINES = 1_000_000
_FLUSH = 100_000


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """Set of 16-byte digests with deletion: 4 fingerprints of 16 bits a bucket, two buckets a key."""

    SLOTS, KICKS = 4, 500

    def __init__(self, keys: int, table: np.ndarray | None = None):
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, keys) / (self.SLOTS * 0.8)))))
        self.table = np.zeros((buckets, self.SLOTS), dtype=np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    @staticmethod
    def split(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket words and non-zero fingerprints of an (n, 2) array of 64-bit halves."""
        return digests[:, 0], (digests[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def other(self, bucket, print_):
        return bucket ^ (int(print_) * 0x5BD1E995 & self.mask)

    def insert(self, digest_: bytes) -> bool:
        word, print_ = self.split(np.frombuffer(digest_, dtype=np.uint64).reshape(1, 2))
        print_ = int(print_[0])
        bucket = int(word[0]) & self.mask
        for b in (bucket, self.other(bucket, print_)):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = print_
                return True
        for kick in range(self.KICKS):
            slot = (kick + print_) % self.SLOTS
            print_, self.table[bucket, slot] = int(self.table[bucket, slot]), print_
            bucket = self.other(bucket, print_)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        return False

    def delete(self, digest_: bytes) -> bool:
        word, print_ = self.split(np.frombuffer(digest_, dtype=np.uint64).reshape(1, 2))
        bucket = int(word[0]) & self.mask
        for b in (bucket, self.other(bucket, print_[0])):
            held = np.flatnonzero(self.table[b] == print_[0])
            if len(held):
                self.table[b, held[0]] = 0
                return True
        return False

    def probe(self, digests: np.ndarray) -> np.ndarray:
        word, print_ = self.split(digests)
        one = (word & np.uint64(self.mask)).astype(np.int64)
        two = one ^ (print_.astype(np.int64) * 0x5BD1E995 & self.mask)
        return (self.table[one] == print_[:, None]).any(axis=1) | (self.table[two] == print_[:, None]).any(axis=1)

    @classmethod
    def of(cls, digests: list[bytes]) -> CuckooFilter:
        room = len(digests)
        while True:
            made = cls(room)
            if all(made.insert(d) for d in digests):
                return made
            room = 2 * room + 8


def shard_of(key, shards: int):
    """Shard of a digest column, and the same from its bytes in ``shards_of``."""
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def shards_of(digests: np.ndarray, shards: int) -> np.ndarray:
    head = digests.view(np.uint8).reshape(len(digests), 16)[:, :4].astype(np.int64)
    return (head[:, 0] << 24 | head[:, 1] << 16 | head[:, 2] << 8 | head[:, 3]) % shards


def _count(sign: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flush():
            out = pa.record_batch([pa.array(list(seen), pa.binary()), pa.array([sign * v for v in seen.values()], pa.int64())], ["key", "n_docs"])
            seen.clear()
            return out

        for batch in batches:
            for text in texts_of(batch.column(0)):
                for key in {line_key(x) for x in text.as_py().split(b"\n")}:
                    if key:
                        d = digest(key)
                        seen[d] = seen.get(d, 0) + 1
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    return each


def line_counts(docs: DataFrame, sign: int = 1) -> DataFrame:
    """(key, n_docs): documents per line key, pre-aggregated in the scan so that a hot line is one row a task."""
    return docs.select("text").mapInArrow(_count(sign), "key binary, n_docs long").groupBy("key").agg(F.sum("n_docs").alias("n_docs"))


def _filter(table: bytes) -> CuckooFilter:
    return CuckooFilter(0, np.frombuffer(table, dtype=np.uint16).reshape(-1, CuckooFilter.SLOTS))


def _packed_keys(digests: np.ndarray) -> pa.Array:
    """16-byte digests as a binary column."""
    flat = np.ascontiguousarray(digests).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _slice_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of each slice with line keys: ids, and (row, digest) of every row's distinct keys."""
    for batch in batches:
        for part in slices(batch):
            rows, keys = [], []
            for i, text in enumerate(texts_of(part.column(1))):
                for key in {line_key(x) for x in text.as_py().split(b"\n")}:
                    if key:
                        rows.append(i)
                        keys.append(digest(key))
            if keys:
                yield part.column(0), np.array(rows), np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)


@dataclass
class LineStore:
    """Reference counts of all line keys, and filters of the keys in at least ``min_docs`` documents."""

    spark: SparkSession
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS) -> LineStore:
        counts = cut(line_counts(docs), "line-counts")
        keys = counts.filter(F.col("n_docs") >= min_docs).count()
        shards = max(1, -(-keys // SHARD_KEYS))
        return cls(docs.sparkSession, counts, cls._filters(counts, shards, min_docs), shards, min_docs)

    @staticmethod
    def _filters(counts: DataFrame, shards: int, min_docs: int) -> DataFrame:
        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.of(sorted(map(bytes, pdf["key"])))
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [made.table.tobytes()]})

        hot = counts.filter(F.col("n_docs") >= min_docs).select(shard_of(F.col("key"), shards).alias("shard"), "key")
        return cut(hot.groupBy("shard").applyInPandas(build, "shard int, filter binary"), "line-filters")

    def _changed(self, docs: DataFrame, sign: int) -> LineStore:
        """Counts plus or minus those of ``docs``; crossing keys are inserted into or deleted from the filters."""
        delta = line_counts(docs, sign).withColumnRenamed("n_docs", "change")
        joined = self.counts.join(delta, "key", "full").select("key", F.coalesce("n_docs", F.lit(0)).alias("was"), (F.coalesce("n_docs", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("n_docs"))
        joined = cut(joined, "line-counts")
        shards, least = self.shards, self.min_docs
        moved = joined.filter((F.col("was") >= least) != (F.col("n_docs") >= least)).select(shard_of(F.col("key"), shards).alias("shard"), "key", (F.col("n_docs") >= least).alias("enters"))

        def apply(key, held: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
            if len(held):
                table = np.frombuffer(held["filter"].iloc[0], dtype=np.uint16).reshape(-1, CuckooFilter.SLOTS).copy()
                made = CuckooFilter(0, table)
            else:
                made = CuckooFilter(len(moves))
            ok = True
            for k, enters in zip(moves["key"], moves["enters"], strict=True):
                ok &= made.insert(bytes(k)) if enters else made.delete(bytes(k))
            return pd.DataFrame({"shard": [key[0]], "filter": [made.table.tobytes()], "ok": [bool(ok)]})

        filters = cut(self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(apply, "shard int, filter binary, ok boolean"), "line-filters")
        counts = joined.filter(F.col("n_docs") > 0).select("key", "n_docs")
        if filters.filter(~F.col("ok")).limit(1).count():  # a filter is full: rebuild it from the exact counts
            return LineStore(self.spark, counts, self._filters(counts, shards, least), shards, least)
        return LineStore(self.spark, counts, filters.select("shard", "filter"), shards, least)

    def insert(self, docs: DataFrame) -> LineStore:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineStore:
        return self._changed(docs, -1)

    def _probe(self):
        """The filters for all executors if their size allows it, else None."""
        if (self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0) > FILTER_BYTES:
            return None
        return self.spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in self.filters.collect()})

    def _candidates(self, docs: DataFrame) -> DataFrame:
        """(doc_id, key): keys of every document that its filter holds."""
        held, shards = self._probe(), self.shards
        kind = docs.schema["doc_id"].dataType.simpleString()
        docs = docs.select("doc_id", "text")
        if held is not None:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                filters = {k: _filter(v) for k, v in held.value.items()}
                for ids, rows, digests in _slice_keys(batches):
                    ok, shard = np.zeros(len(rows), dtype=bool), shards_of(digests, shards)
                    for s, f in filters.items():
                        mine = np.flatnonzero(shard == s)
                        ok[mine] = f.probe(digests[mine])
                    yield pa.record_batch([ids.take(pa.array(rows[ok])), _packed_keys(digests[ok])], ["doc_id", "key"])

            return docs.mapInArrow(run, f"doc_id {kind}, key binary")
        lines = self.counts.agg(F.sum("n_docs")).first()[0] or 0
        salts = max(1, -(-lines // (shards * SALT_LINES)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, rows, digests in _slice_keys(batches):
                shard = shards_of(digests, shards).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)[: len(order)])
                parts = np.split(order, at[1:])
                salt = [int(digests[p[0], 1] % np.uint64(salts)) for p in parts]
                offsets = pa.array(np.append(at, len(order)).astype(np.int32))
                yield pa.record_batch([pa.array(shard[order][at]), pa.array(salt, pa.int32()), pa.ListArray.from_arrays(offsets, ids.take(pa.array(rows[order]))), pa.array([digests[p].tobytes() for p in parts], pa.binary())], ["shard", "salt", "ids", "keys"])

        def probe(filters: pa.Table, rows: pa.Table) -> pa.Table:
            none = pa.table({"doc_id": pa.array([], rows.schema.field("ids").type.value_type), "key": pa.array([], pa.binary())})
            if not filters.num_rows or not rows.num_rows:
                return none
            digests = np.frombuffer(b"".join(rows.column("keys").to_pylist()), dtype=np.uint64).reshape(-1, 2)
            ok = _filter(filters.column("filter")[0].as_py()).probe(digests)
            return pa.table({"doc_id": rows.column("ids").combine_chunks().flatten().filter(pa.array(ok)), "key": _packed_keys(digests[ok])})

        dealt = docs.mapInArrow(deal, f"shard int, salt int, ids array<{kind}>, keys binary")
        filters = self.filters.select("shard", "filter", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        return filters.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInArrow(probe, f"doc_id {kind}, key binary")

    def hits(self, docs: DataFrame) -> DataFrame:
        """(doc_id, keys): keys to drop of every document that has some."""
        hot = self.counts.filter(F.col("n_docs") >= self.min_docs).select("key")
        return self._candidates(docs).join(hot, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def rewrite(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``text`` as it stays, ``n_lines`` (before) and ``n_dropped``; null texts stay null unless they lose a line."""
        docs = docs.drop("n_lines", "n_dropped")
        hits = self.hits(docs).withColumnsRenamed({"doc_id": "__hit_id", "keys": "__keys"})
        joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits["__hit_id"]), "left").drop("__hit_id")
        out = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["n_lines long", "n_dropped long"]
        at = docs.columns.index("text")

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, lines, dropped = [], [], []
                for text, keys in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                    text, keys = text.as_py(), keys.as_py()
                    lost = 0
                    if keys:
                        gone = set(keys)
                        parts = (text or "").encode().split(b"\n")
                        kept = [x for x in parts if not ((k := line_key(x)) and digest(k) in gone)]
                        lost = len(parts) - len(kept)
                        lines.append(len(parts))
                        text = b"\n".join(kept).decode() if lost else text
                    else:
                        lines.append((text or "").count("\n") + 1)
                    texts.append(text)
                    dropped.append(lost)
                columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.record_batch([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*batch.schema.names[:-1], "n_lines", "n_dropped"])

        return joined.mapInArrow(drop, ", ".join(out))


def sha256_text(column: str):
    """Lowercase hex of the text's UTF-8 bytes; a null text counts as empty."""
    return F.sha2(F.coalesce(F.col(column), F.lit("")), 256)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return LineStore.build(docs).rewrite(docs).select("doc_id", "n_lines", "n_dropped", sha256_text("text").alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: lines found in too many documents go; the documents stay, if need be with an empty text."""
    rows = packed(docs)
    return restored(LineStore.build(rows).rewrite(rows), docs, text_changed=True)


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE hot.k IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id
"""
