"""N-gram Jaccard join by parity sketches, and the components of its links.

A document's shingles (five lower-cased words, hashed to 64 bits) are XOR-ed
into a parity sketch: each shingle flips one bit, so the Hamming distance of two
sketches is at most the size of the sets' symmetric difference, and folding a
sketch in half keeps that. Two sets of n and m shingles with a Jaccard index of
at least 0.8 differ in at most D = (n + m) / 9 shingles.

Candidates. In each band of sizes the sketch is cut into P parts, shingles fall
into parts by their hash, and a part's parity is stood for by the XOR of its
shingles. At most D parts of a linked pair differ, so the pigeonhole leaves
P - D equal ones; with parts in one global order (hash order, parts made of
frequent shingles alone after all others, empty ones last) two linked documents
share one of their first D + 1 parts. Only those are keys. A document whose
partner may lie in the next band has keys there too.

Exact copies are one class, found by a 128-bit digest of the set, and the class
is joined once. The members of a key are paired with one of them (drawn by
hash), pairs whose sketches are too far apart are dropped, the rest are verified
on the texts. If the verified links leave a key's members in several components,
its members of different components are compared: the pairs of a key of few
members as they are, those of others in blocks, sketches first. So every linked
pair is verified or already connected; no pair within a component is listed.

Hashes stand for shingles: sets of two documents could differ from the words'
with a chance of about n * n / 2**64.

Cases: null texts and texts without words have no shingles and stay alone; with
fewer than five words the whole sequence is one shingle; repeated rows and equal
texts are one class; a null id is left out of the smallest id of a component
and gets the component's id; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.llm.components import components
from sparsewright.llm.sieve import Sieve
from sparsewright.llm.store import cut
from sparsewright.llm.vec import LOWER, NON_SPACE, U64, Slice, mix, prefix_hash, slices, span_hash, texts_of

WORDS = 5
#: Jaccard threshold, as a fraction.
NUMERATOR, DENOMINATOR = 80, 100
#: Keys a reduce bucket is sized for.
BUCKET_KEYS = 500_000
#: Members of a key that are compared at a time.
BLOCK = 512
#: Members of a key whose pairs are listed without their sketches.
FEW = 8
#: A shingle is frequent if this share of the documents of a task holds it. It changes the order of keys, never a link.
FREQUENT = 0.01
#: Bytes of text whose frequent shingles, or keys, are gathered at a time.
WIDE = 4 << 20
#: Smallest open keys of a class that tell which of its shared keys lists a pair.
OWN_KEYS = 32
MAX_FREQUENT = 400_000
_EMPTY = U64(0xA5A5A5A5DEADBEEF)


def largest_difference(n, m):
    """Most shingles in which two linked sets of these sizes can differ."""
    return (n + m) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    held = Slice(texts)
    begin, end, first = held.words(NON_SPACE)
    h = span_hash(prefix_hash(LOWER[held.buf]), begin, end)
    out = []
    if len(h) >= WORDS:
        rolled = h[: len(h) - WORDS + 1].copy()
        for k in range(1, WORDS):
            rolled = rolled * U64(0x9E3779B97F4A7C15) + h[k : len(h) - WORDS + 1 + k]
        rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a)], dtype=U64))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def class_of(print_: bytes) -> int:
    """A class's number: the first half of its digest."""
    return int.from_bytes(print_[:8], "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles over 2**k bits, two to four times their number."""
    bits = 1 << max(6, int(2 * max(1, len(s)) - 1).bit_length())
    return np.packbits((np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def fold(a: np.ndarray, size: int) -> np.ndarray:
    """Rows of bytes, halves XOR-ed down to ``size`` bytes."""
    while a.shape[1] > size:
        half = a.shape[1] // 2
        a = a[:, :half] ^ a[:, half:]
    return a


def band_of(n: int) -> int:
    return n.bit_length()


def parts_of(band: int) -> int:
    """Parts of a band, whose sizes are below 2**band."""
    top = 1 << band
    return 2 * top if top <= 64 else top // 2


def keys_of(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The document's pigeonhole keys: its first D + 1 parts in the global order, in each of its bands."""
    n = len(s)
    most = n * DENOMINATOR // NUMERATOR
    d = int(largest_difference(n, most))
    if n == 0 or d == 0:
        return np.zeros(0, dtype=U64)  # links only with its own class
    weak = np.zeros(n, dtype=bool)
    if len(frequent):
        slot = np.searchsorted(frequent, s)
        slot[slot == len(frequent)] = 0
        weak = frequent[slot] == s
    out = []
    for band in {band_of(n), band_of(most)}:
        parts = parts_of(band)
        part = (s >> U64(20)) % U64(parts)
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        value = np.bitwise_xor.reduceat(s[order], at)
        strong = ~np.logical_and.reduceat(weak[order], at)
        token = mix(mix(value) + ranked[at] * U64(0x9E3779B97F4A7C15) + U64(band))
        token = token[np.lexsort((token, ~strong))][: d + 1]
        if len(token) < d + 1:
            empty = np.setdiff1d(np.arange(parts, dtype=U64), ranked[at])
            token = np.append(token, np.sort(mix(_EMPTY + empty * U64(64) + U64(band)))[: d + 1 - len(token)])
        out.append(token)
    return np.concatenate(out)


def _summaries(at_id: int, at_text: int):
    """Rows of documents, and one row of locally frequent shingles for each task."""

    def run(batches):
        heavy: dict[int, int] = {}
        total = 0
        kind = None
        for batch in batches:
            for part in slices(batch, WIDE):
                sets = [s for small in slices(part) for s in shingle_sets(texts_of(small.column(at_text)))]
                kind = part.column(at_id).type
                total += len(sets)
                if len(sets) >= 16:
                    values, counts = np.unique(np.concatenate(sets), return_counts=True)
                    for k in np.flatnonzero(counts >= max(4, FREQUENT * len(sets))):
                        heavy[int(values[k])] = heavy.get(int(values[k]), 0) + int(counts[k])
                prints = [fingerprint(s) for s in sets]
                n = len(sets)
                yield pa.record_batch([part.column(at_id), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([class_of(x) for x in prints], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.nulls(n, pa.binary())], ["doc_id", "n", "print", "ent", "sketch", "heavy"])
        if total:
            kept = np.array([k for k, c in heavy.items() if c >= max(8, FREQUENT / 2 * total)], dtype=U64)
            yield pa.record_batch([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([kept.tobytes()], pa.binary())], ["doc_id", "n", "print", "ent", "sketch", "heavy"])

    return run


def _frequent(rows: DataFrame) -> np.ndarray:
    """Shingles that are frequent in most tasks that could see them; at most MAX_FREQUENT, the most widespread."""

    def spread(batches):
        for batch in batches:
            for x in batch.column(0):
                yield pa.record_batch([pa.array(np.frombuffer(x.as_py(), dtype=np.int64))], ["shingle"])

    tasks = rows.select("heavy").mapInArrow(spread, "shingle long").groupBy("shingle").count()
    got = tasks.orderBy(F.desc("count"), "shingle").limit(MAX_FREQUENT).select("shingle").toArrow()
    return np.sort(got.column(0).to_numpy().astype(np.int64).view(U64)) if got.num_rows else np.zeros(0, dtype=U64)


def _key_rows(held, buckets: int):
    """Packed (bucket, keys, classes): one row for each slice and bucket."""

    def run(batches):
        frequent = held.value
        for batch in batches:
            for part in slices(batch, WIDE):
                of_slice: dict[int, np.ndarray] = {}
                for small in slices(part):
                    for s in shingle_sets(texts_of(small.column(0))):
                        ent = class_of(fingerprint(s))
                        if ent not in of_slice:
                            of_slice[ent] = keys_of(s, frequent)
                if not of_slice:
                    continue
                keys = np.concatenate(list(of_slice.values()))
                ents = np.repeat(np.array(list(of_slice), dtype=np.int64), [len(k) for k in of_slice.values()])
                bucket = (keys >> U64(32)) % U64(buckets)
                order = np.argsort(bucket, kind="stable")
                # only buckets that the slice has keys for: their number does not grow with that of all buckets
                at = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)[: len(order)])
                rows, cut_ = bucket[order][at].astype(np.int32), np.split(order, at[1:]) if len(at) else []
                yield pa.record_batch([pa.array(rows), pa.array([keys[o].tobytes() for o in cut_], pa.binary()), pa.array([ents[o].tobytes() for o in cut_], pa.binary())], ["bucket", "keys", "ents"])

    return run


def _stars(table: pa.Table) -> pa.Table:
    """(key, a, b) for each key with several classes: every class b with the key's drawn class a; the key is 0 if there are two."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=U64)
    ents = np.frombuffer(b"".join(table.column("ents").to_pylist()), dtype=np.int64)
    order = np.lexsort((mix(keys ^ ents.view(U64)), keys))
    keys, ents = keys[order], ents[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (ents[1:] != ents[:-1]))[: len(keys)]
    keys, ents = keys[fresh], ents[fresh]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    size = np.diff(np.append(at, len(keys)))
    lead, group = np.repeat(ents[at], size), np.repeat(size, size)
    member = np.ones(len(keys), dtype=bool)
    member[at] = False
    k, a, b = np.where(group > 2, keys, U64(0))[member].view(np.int64), lead[member], ents[member]
    two = k == 0
    low, high = np.minimum(a, b)[two], np.maximum(a, b)[two]
    pairs = np.unique(np.column_stack([low, high]), axis=0)
    return pa.table({"key": np.concatenate([np.zeros(len(pairs), dtype=np.int64), k[~two]]), "a": np.concatenate([pairs[:, 0], a[~two]]), "b": np.concatenate([pairs[:, 1], b[~two]])})


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _near(batches):
    """Pairs (a, b, na, sa, nb, sb) whose sizes and sketches allow a link."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        ok = (na * DENOMINATOR >= nb * NUMERATOR) & (nb * DENOMINATOR >= na * NUMERATOR)
        most = largest_difference(na, nb)
        for i in np.flatnonzero(ok):
            x, y = (np.frombuffer(batch.column(j)[int(i)].as_py(), dtype=np.uint8)[None] for j in (3, 5))
            size = min(x.shape[1], y.shape[1])
            ok[i] = hamming(fold(x, size), fold(y, size))[0] <= most[i]
        yield pa.record_batch([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])


def _verify(batches):
    """Of (a, b, packed a, packed b): the pairs that are linked."""
    unpack = zstandard.ZstdDecompressor().decompress
    last, held = None, None
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ok = np.zeros(len(a), dtype=bool)
        mine, other = batch.column(2), batch.column(3)
        for lo in range(0, len(a), 256):
            hi = min(len(a), lo + 256)
            sets = shingle_sets(pa.array([unpack(x.as_py()) for x in other.slice(lo, hi - lo)], pa.binary()))
            for i in range(lo, hi):
                if a[i] != last:
                    last, held = a[i], shingle_sets(pa.array([unpack(mine[i].as_py())], pa.binary()))[0]
                s = sets[i - lo]
                both = len(np.intersect1d(held, s, assume_unique=True))
                ok[i] = DENOMINATOR * both >= NUMERATOR * (len(held) + len(s) - both)
        keep = pa.array(ok)
        yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])


def _few(batches):
    """Rows (key, ent, comp) sorted by key: the pairs of different components within each key."""
    rest = np.zeros((3, 0), dtype=np.int64)
    for batch in batches:
        key, ent, comp = now = np.concatenate([rest, [c.to_numpy() for c in batch.columns]], axis=1)
        for step in range(1, FEW):
            # pairs within the rest were listed with the batch before
            at = np.arange(max(0, rest.shape[1] - step), len(key) - step)
            at = at[(key[at] == key[at + step]) & (comp[at] != comp[at + step])]
            if len(at):
                a, b = ent[at], ent[at + step]
                both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
                yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])
        rest = now[:, max(0, len(key) - FEW + 1) :]


def _blocks(batches):
    """Rows (key, i, j, ent, comp, n, sketch, low) sorted by (key, i, j): near pairs of different components, group by group.

    A pair that shares several keys is listed by the least of them, as far as
    ``low``, the classes' least keys, tells; never by none.
    """

    def pairs(g: pa.Table):
        ent, comp, n = (g.column(c).to_numpy() for c in ("ent", "comp", "n"))
        sk = g.column("sketch").to_pylist()
        size = min(map(len, sk))
        rows = np.concatenate([fold(np.frombuffer(x, dtype=np.uint8)[None], size) for x in sk])
        key = g.column("key")[0].as_py()
        low = np.full((len(ent), OWN_KEYS), key, dtype=np.int64)
        for r, x in enumerate(g.column("low").to_pylist()):
            low[r, : len(x)] = x
        found_a, found_b = [], []
        for i in range(len(ent) - 1):
            m = n[i + 1 :]
            ok = np.flatnonzero((comp[i + 1 :] != comp[i]) & (n[i] * DENOMINATOR >= m * NUMERATOR) & (m * DENOMINATOR >= n[i] * NUMERATOR))
            if len(ok):
                ok = ok[hamming(rows[i + 1 + ok], rows[i]) <= largest_difference(n[i], m[ok])] + i + 1
                ok = ok[~np.isin(low[ok], low[i][low[i] < key]).any(axis=1)]
                found_a += [np.minimum(ent[i], ent[ok])]
                found_b += [np.maximum(ent[i], ent[ok])]
        if found_a:
            both = np.unique(np.column_stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=0)
            return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])
        return None

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        k = np.column_stack([now.column(c).to_numpy() for c in ("key", "i", "j")])
        edge = np.append(0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1)
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if (out := pairs(now.slice(lo, hi - lo))) is not None:
                yield out
        rest = now.slice(edge[-1]).combine_chunks()
    if rest is not None and (out := pairs(rest)) is not None:
        yield out


class NgramJoin:
    """Steps of the join over (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", "text")
        self.spark = docs.sparkSession
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = cut(self.docs.mapInArrow(_summaries(0, 1), f"doc_id {kind}, n long, print binary, ent long, sketch binary, heavy binary"), "join-documents")
        #: One row a document.
        self.rows = rows.filter(F.col("heavy").isNull()).drop("heavy")
        self.frequent = _frequent(rows.filter(F.col("heavy").isNotNull()))
        #: One row a class: its size, sketch and a document that holds it.
        self.classes = cut(self.rows.filter(F.col("n") > 0).groupBy("ent").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "join-classes")

    def stars(self) -> DataFrame:
        total = self.classes.agg(F.sum("n")).first()[0] or 0
        buckets = max(8, int(total // 3 // BUCKET_KEYS) + 1)
        held = self.spark.sparkContext.broadcast(self.frequent)  # MAX_FREQUENT numbers at most
        packed = self.docs.select("text").mapInArrow(_key_rows(held, buckets), "bucket int, keys binary, ents binary")
        return cut(packed.groupBy("bucket").applyInArrow(_stars, "key long, a long, b long"), "join-stars")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose sketches allow a link."""
        one = self.classes.select(F.col("ent").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        two = self.classes.select(F.col("ent").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        sides = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return sides.join(one, "a").join(two, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(_near, "a long, b long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """(u, v): the pairs whose texts are linked. Only texts of asked ids travel, packed once they are known to be the class's own."""
        pairs = cut(pairs, "join-near")
        ents = pairs.select(F.col("a").alias("ent")).unionAll(pairs.select(F.col("b").alias("ent"))).distinct()
        # a class without any doc_id cannot be fetched by it; such rows are joined by a null-safe key
        wanted = cut(ents.join(self.classes.select("ent", "doc_id"), "ent"), "join-wanted")
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        may, _ = Sieve.of(wanted.select("doc_id")).split(self.docs)
        texts = wanted.join(may.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).select("ent", "text")
        # an id that is shared by several rows fetches several texts: keep the class's own
        texts = cut(texts.mapInArrow(_own, "ent long, packed binary").dropDuplicates(["ent"]), "join-texts")
        joined = pairs.join(texts.withColumnsRenamed({"ent": "b", "packed": "pb"}), "b").join(texts.withColumnsRenamed({"ent": "a", "packed": "pa"}), "a")
        return cut(joined.select("a", "b", "pa", "pb").mapInArrow(_verify, "u long, v long"), "join-links")

    def unresolved(self, stars: DataFrame, roots: DataFrame) -> DataFrame:
        """Near pairs of different components within keys of three classes or more, but those of ``stars``."""
        many = stars.filter(F.col("key") != 0)
        members = many.select("key", F.col("b").alias("ent")).unionAll(many.select("key", F.col("a").alias("ent")).distinct())
        members = members.join(roots.withColumnsRenamed({"node": "ent", "root": "comp"}), "ent", "left").withColumn("comp", F.coalesce("comp", "ent"))
        members = cut(members, "join-members")
        open_ = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo != hi").select("key", "size")
        held = cut(members.join(open_, "key"), "join-open-members")
        tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        few = held.filter(F.col("size") <= FEW).select("key", "ent", "comp").repartition("key").sortWithinPartitions("key").mapInArrow(_few, "a long, b long")
        few = self.near(cut(few.distinct().join(tried, ["a", "b"], "left_anti"), "join-few"))
        held = held.filter(F.col("size") > FEW)
        low = held.groupBy("ent").agg(F.slice(F.array_sort(F.collect_set("key")), 1, OWN_KEYS).alias("low"))
        held = held.join(self.classes.select("ent", "n", "sketch").join(low, "ent"), "ent")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("ent", "key"), blocks).cast("int")
        # a pair is looked up among the keys below its own
        below = F.filter("low", lambda k: k < F.col("key")).alias("low")
        dealt = held.select("key", mine.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"), "ent", "comp", "n", "sketch", below)
        dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "ent", "comp", "n", "sketch", "low")
        many = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocks, "a long, b long")
        return many.distinct().join(tried, ["a", "b"], "left_anti").unionAll(few).distinct()

    def roots(self) -> DataFrame:
        """(node, root): components of the linked classes."""
        stars = self.stars()
        links = self.links(self.near(stars))
        first = cut(components(links), "join-roots")
        more = cut(self.unresolved(stars, first), "join-open")
        if more.isEmpty():
            return first
        return cut(components(links.unionAll(self.links(more))), "join-roots")

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), a row a document."""
        roots = self.roots().withColumnsRenamed({"node": "ent"})
        # by classes first: of a hot class one row meets the component's other classes
        tied = self.classes.join(roots, "ent", "left").select("ent", "doc_id", F.coalesce("root", "ent").alias("comp"))
        least = tied.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        by_class = cut(tied.join(least, "comp").select("ent", "component_id"), "join-components")
        return self.rows.join(by_class, "ent", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _own(batches):
    """Of (ent, text) rows those whose text is of class ent; the text packed."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch):
            texts = texts_of(part.column(1))
            ok = np.array([class_of(fingerprint(s)) for s in shingle_sets(texts)], dtype=np.int64) == part.column(0).to_numpy()
            held = pa.array(ok)
            yield pa.record_batch([part.column(0).filter(held), pa.array([packer.compress(x.as_py()) for x in texts.filter(held)], pa.binary())], ["ent", "packed"])


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(spark.read.parquet(f"{sf_dir}/documents.parquet")).components()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row of the smallest doc_id stays; of rows that repeat that id with one text, one."""
    own = NgramJoin(docs).components()
    mine = F.col("component_id").eqNullSafe(F.col("doc_id")).cast("int")
    ids = cut(own.groupBy(F.col("doc_id").alias("kept_id")).agg(F.sum(mine).alias("rows")), "kept")
    # ids of one kept row each, most of all, need no join
    asked, kept = Sieve.of(ids.filter("rows != 1").select("kept_id")).split(docs)
    of = lambda ids: asked.join(ids, asked["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")
    kept = kept.unionByName(of(ids.filter("rows = 1")))
    again = ids.filter("rows > 1")
    if again.isEmpty():
        return kept
    return kept.unionByName(of(again).dropDuplicates(["doc_id", "text"]))


#: The same by comparing all shingle sets that share a shingle; components by following links.
OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
         JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1, 2
"""
