"""Removal of repeated 400-byte strings by column-wise construction of a collection's transform.

The exact test is a Burrows-Wheeler construction in rounds over many short
documents (the contexts below), by columns from the right. A round inserts one
symbol of every context before its suffix: the transform's last segment holds
those symbols in the order of their suffixes, a stable sort by symbol gives the
next order, and neighbours' common prefixes are one more than the least common
prefix between their tails (none for different symbols). Segments of order and
common prefixes are appended to one external file in the cluster's shared
folder, read back in sequence for the verdicts. Symbols count as marked with
their column, so suffixes of different columns do not interleave, and a round
adds a segment to the file instead of rewriting all of it.

Which contexts meet. Every ``LENGTH``-byte window has an anchor: the place of
the least hash among its ``GRAM``-byte strings, the last one of equals. Equal
windows have equal anchor strings, at equal places in the window. So

1. anchors of all texts are counted by their string's hash over the whole table;
2. around each anchor whose string occurs twice or more, the bytes that its
   windows can cover are a context, aligned at the anchor; equal contexts are
   one with a count (counted in the map task first);
3. contexts are dealt by their anchor's string and go through the construction;
   a window is repeated if its suffix shares ``LENGTH`` bytes with a neighbour,
   or if its context occurs twice.

A string's contexts are one shard up to ``SHARD_CONTEXTS``. Beyond, they are
salted; of equal windows in a salted shard one leads, and the leading windows
of all salts meet by their hashes.

Passages of over 50 words can be shorter than 400 bytes. ``n_shared_strings``
tells of them and changes nothing else: any 51 words have an anchor string of
26 words, and the column counts those of the text that another row's text has.
It is not 0 wherever 51 words in a row stand in another row too, and 0 where no
26 words do.

Cases: a null text is empty; texts shorter than ``LENGTH`` bytes lose nothing;
repeated rows repeat each other's windows; ids may be null or shared; an empty
table gives an empty result; further columns are kept by ``rewrite``'s callers
through the text alone.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.llm.vec import NON_SPACE, U64, Slice, mix, powers, prefix_hash, slices, span_hash, texts_of
from sparsewright.plans.scratch import cut, shared_dir

LENGTH = 400
GRAM = 200
#: Windows that one anchor can serve.
SPAN = LENGTH - GRAM + 1
#: Columns of a context: SPAN - 1 bytes before the anchor and LENGTH from it on.
WIDTH = SPAN - 1 + LENGTH
SHARD_CONTEXTS = 40_000
#: Strings at most that are broadcast to meet their rows.
HOT = 1000
#: Contexts that a shard of many strings is sized for.
COMMON_SHARD = 3000
#: Words of a passage, and of the strings that tell of it.
PASSAGE, STRING = 51, 26
#: Strings that a bucket of their counting is sized for.
BUCKET_STRINGS = 200_000
_PAD = 256
_PLACE_BITS = 24


def _least(h: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Anchors of the windows that begin at ``starts``, in order: of each window's ``span`` hashes the place of the least."""
    bits = max(_PLACE_BITS, len(h).bit_length())
    low = U64((1 << bits) - 1)
    key = (h & ~low) | (low - np.arange(len(h)).astype(U64))
    blocks = -(-len(key) // span) + 1
    grid = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=U64)
    grid[: len(key)] = key
    grid = grid.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (low - (np.minimum(behind[starts], ahead[starts + span - 1]) & low)).astype(np.int64)
    return place[np.append(True, place[1:] != place[:-1])[: len(place)]]


def _windows(first: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows inside the runs [first[i], first[i + 1])."""
    n = np.maximum(np.diff(first) - length + 1, 0)
    return np.repeat(first[:-1] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))


def anchors(held: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash): places in the buffer of all windows' anchors, in order, and their strings' hashes."""
    # texts and the separators between them are runs; the latter are shorter than any window
    starts = _windows(np.column_stack([held.at, held.at + held.size]).ravel(), LENGTH) if held.n else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    sums = prefix_hash(held.buf)
    at = np.arange(len(held.buf) - GRAM)
    h = span_hash(sums, at, at + GRAM)
    place = _least(h, starts, SPAN)
    return place, h[place]


def word_strings(held: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the anchor strings of all runs of ``PASSAGE`` words, each of a text once."""
    begin, end, first = held.words(NON_SPACE)
    starts = _windows(first, PASSAGE)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    each = span_hash(prefix_hash(held.buf), begin, end)
    up, down = powers(len(each) + 1)
    sums = np.zeros(len(each) + 1, dtype=U64)
    np.cumsum(each * up[: len(each)], out=sums[1:])
    n = len(each) - STRING + 1
    h = mix((sums[STRING:] - sums[:n]) * down[:n])
    place = _least(h, starts, PASSAGE - STRING + 1)
    found = np.unique(np.column_stack([(np.searchsorted(first, place, side="right") - 1).astype(U64), h[place]]), axis=0)
    return found[:, 0].astype(np.int64), np.ascontiguousarray(found[:, 1])


def row_key(text: bytes, doc_id) -> int:
    """Number of a row; rows with equal id and text have one."""
    k = xxhash.xxh3_64_intdigest(text, seed=xxhash.xxh3_64_intdigest(repr(doc_id).encode()))
    return k - (1 << 64) if k >> 63 else k


def _anchor_rows(batches):
    """(gram, rid, place, more): a row for each anchor string of a slice; ``more`` packs its further (rid, place) pairs, so a string that fills a slice is one row."""
    for batch in batches:
        for part in slices(batch):
            texts = texts_of(part.column(1))
            held = Slice(texts)
            place, h = anchors(held)
            doc = np.searchsorted(held.at, place, side="right") - 1
            rid = np.array([row_key(t.as_py(), i.as_py()) for t, i in zip(texts, part.column(0), strict=True)], dtype=np.int64)
            order = np.argsort(h, kind="stable")
            h, pairs = h[order], np.column_stack([rid[doc], place - held.at[doc]])[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            last = np.append(first[1:], len(h))[: len(first)]
            more = [None if e - b == 1 else pairs[b + 1 : e].tobytes() for b, e in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.record_batch([pa.array(h[first].view(np.int64)), pa.array(np.ascontiguousarray(pairs[first, 0])), pa.array(np.ascontiguousarray(pairs[first, 1])), pa.array(more, pa.binary())], ["gram", "rid", "place", "more"])


def _unpacked(batches):
    """(gram, rid, place) of all of ``_anchor_rows``; of a row's places with one string, a list."""
    for batch in batches:
        gram, rid, place = (batch.column(i).to_numpy() for i in range(3))
        pairs = [np.column_stack([rid, place])]
        grams = [gram]
        for i in np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False)).tolist():
            x = np.frombuffer(batch.column(3)[i].as_py(), dtype=np.int64).reshape(-1, 2)
            pairs.append(x)
            grams.append(np.full(len(x), gram[i]))
        grams, pairs = np.concatenate(grams), np.concatenate(pairs)
        order = np.lexsort((pairs[:, 0], grams))
        grams, pairs = grams[order], pairs[order]
        first = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (pairs[1:, 0] != pairs[:-1, 0]))[: len(grams)])
        last = np.append(first[1:], len(grams))[: len(first)]
        yield pa.record_batch([pa.array(grams[first]), pa.array(np.ascontiguousarray(pairs[first, 0])), pa.array([pairs[b:e, 1].tobytes() for b, e in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())], ["gram", "rid", "places"])


def _packed_rows(batches):
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch):
            texts = texts_of(part.column(1)).to_pylist()
            rid = [row_key(t, i) for t, i in zip(texts, part.column(0).to_pylist(), strict=True)]
            yield pa.record_batch([part.column(0), pa.array(rid, pa.int64()), pa.array([packer.compress(t) for t in texts], pa.binary())], ["doc_id", "rid", "packed"])


def _context_rows(batches):
    """Of (rid, packed, grams and places): distinct contexts with counts, and every row's places of each context."""
    unpack = zstandard.ZstdDecompressor().decompress
    held: dict[bytes, list] = {}
    size = 0
    names = ["ctx", "gram", "bytes", "before", "n", "rid", "places"]

    def flush():
        rows = list(held.items())
        held.clear()
        n = len(rows)
        return pa.record_batch([pa.array([k for k, _ in rows], pa.binary()), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.binary()), pa.array([v[2] for _, v in rows], pa.int32()), pa.array([v[3] for _, v in rows], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)

    for batch in batches:
        ctxs, rids, places = [], [], []
        for rid, packed, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            text = unpack(packed.as_py())
            own: dict[bytes, list] = {}
            for one in found.as_py():
                for at in np.unique(np.frombuffer(one["places"], dtype=np.int64)).tolist():
                    low = max(0, at - SPAN + 1)
                    piece = text[low : at + LENGTH]
                    before = at - low
                    ctx = xxhash.xxh3_128_digest(piece, seed=before)
                    if ctx not in held:
                        held[ctx] = [one["gram"], piece, before, 0]
                        size += len(piece)
                    held[ctx][3] += 1
                    own.setdefault(ctx, []).append(at)
            ctxs += own
            rids += [rid] * len(own)
            places += [np.array(x, dtype=np.int64).tobytes() for x in own.values()]
            if size > 24 << 20:
                yield flush()
                size = 0
        n = len(ctxs)
        if n:
            yield pa.record_batch([pa.array(ctxs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(rids, pa.int64()), pa.array(places, pa.binary())], names)
    if held:
        yield flush()


class Rounds:
    """The construction over a matrix of symbols (contexts x columns), ``pad`` where a context has none; its segments go to one external file."""

    def __init__(self, symbols: np.ndarray, pad: int, folder: str):
        self.columns, self.pad = np.ascontiguousarray(symbols.T), pad
        m = symbols.shape[0]
        self.order, self.common = np.arange(m, dtype=np.int32), np.zeros(m, dtype=np.uint16)
        # the transform's last segment: symbols before the suffixes, in their order
        self.transform = self.columns[-1]
        self.files, path = pyarrow.fs.FileSystem.from_uri(folder)
        self.files.create_dir(path, recursive=True)
        self.path = f"{path}/rounds-{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.path)

    def insert(self, column: int) -> None:
        """Put the column's symbols, which the transform's last segment holds in order, before their suffixes; append the new segment."""
        perm = np.argsort(self.transform, kind="stable")
        ranked = self.transform[perm]
        common = np.zeros(len(perm), dtype=np.uint16)
        same = np.flatnonzero((ranked[1:] == ranked[:-1]) & (ranked[1:] != self.pad)) + 1
        if len(same):
            common[same] = 1 + self._least(perm[same - 1] + 1, perm[same])
        self.order, self.common = self.order[perm], common
        if column:
            self.transform = self.columns[column - 1][self.order]
        self.out.write(self.order.tobytes())
        self.out.write(common.tobytes())

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least common prefix in [low, high] of the present order."""
        size = high - low + 1
        out = self.common[low]
        wide = np.flatnonzero(size > 1)
        if not len(wide):
            return out
        low, high, size = low[wide], high[wide], size[wide]
        level = np.frexp(size.astype(np.float64))[1] - 1
        last, far = self.common, np.empty(len(wide), dtype=np.uint16)
        for k in range(int(level.max()) + 1):
            if k:
                half = 1 << (k - 1)
                last = np.minimum(last[: len(last) - half], last[half:])
            mine = np.flatnonzero(level == k)
            far[mine] = np.minimum(last[low[mine]], last[high[mine] - (1 << k) + 1])
        out[wide] = far
        return out

    def segments(self):
        """Insert all columns, then read (column, order, common) back in sequence."""
        m, width = len(self.order), len(self.columns)
        try:
            for column in range(width - 1, -1, -1):
                self.insert(column)
            self.out.close()
            with self.files.open_input_stream(self.path) as held:
                for column in range(width - 1, -1, -1):
                    yield column, np.frombuffer(held.read(4 * m), dtype=np.int32), np.frombuffer(held.read(2 * m), dtype=np.uint16)
        finally:
            if not self.out.closed:
                self.out.close()
            self.files.delete_file(self.path)


def _matrix(pieces: list[bytes], before: np.ndarray, ahead: int, width: int) -> np.ndarray:
    """Contexts aligned so that their anchors stand in column ``ahead``."""
    symbols = np.full((len(pieces), width), _PAD, dtype=np.uint16)
    for row, (piece, b) in enumerate(zip(pieces, before.tolist(), strict=True)):
        symbols[row, ahead - b : ahead - b + len(piece)] = np.frombuffer(piece, dtype=np.uint8)
    return symbols


def repeated(rounds: Rounds, first: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two (contexts x first columns) tables: the suffix shares ``length`` symbols with another; it is the first of those that do."""
    m = len(rounds.order)
    out, lead = np.zeros((m, first), dtype=bool), np.zeros((m, first), dtype=bool)
    for column, order, common in rounds.segments():
        if column < first:
            long = common >= length
            out[order, column] = long | np.append(long[1:], False)
            lead[order, column] = ~long
    return out, lead


def _shard(folder: str):
    return lambda table: _verdicts(table, folder)


def _verdicts(table: pa.Table, folder: str) -> pa.Table:
    """Of a shard's contexts: which of their windows are repeated, as bits over columns; ``lead`` bits mark one window of all that are equal."""
    first: dict[bytes, int] = {}
    count: list[int] = []
    keep = []
    for row, (ctx, n) in enumerate(zip(table.column("ctx").to_pylist(), table.column("n").to_pylist(), strict=True)):
        if ctx in first:
            count[first[ctx]] += n
        else:
            first[ctx] = len(count)
            count.append(n)
            keep.append(row)
    table = table.take(pa.array(keep))
    pieces, before = table.column("bytes").to_pylist(), table.column("before").to_numpy()
    sizes = np.array([len(p) for p in pieces])
    found, lead = repeated(Rounds(_matrix(pieces, before, SPAN - 1, WIDTH), _PAD, folder), SPAN, LENGTH)
    column = np.arange(SPAN)
    low = (SPAN - 1 - before)[:, None]
    valid = (column >= low) & (column + LENGTH <= low + sizes[:, None])
    found |= (np.array(count) >= 2)[:, None]
    found &= valid
    pack = lambda x: [r.tobytes() for r in np.packbits(x, axis=1)]
    return pa.table({"ctx": table.column("ctx"), "found": pa.array(pack(found), pa.binary()), "lead": pa.array(pack(valid & lead), pa.binary())})


def _window_rows(batches):
    """Of (ctx, bytes, before, lead): the leading windows, by the hash of their bytes and column."""
    for batch in batches:
        ctxs, columns, digests = [], [], []
        for ctx, piece, before, lead in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            start = SPAN - 1 - before
            for c in np.flatnonzero(np.unpackbits(np.frombuffer(lead, dtype=np.uint8))[:SPAN]).tolist():
                ctxs.append(ctx)
                columns.append(c)
                digests.append(xxhash.xxh3_128_digest(piece[c - start : c - start + LENGTH], seed=c))
        yield pa.record_batch([pa.array(ctxs, pa.binary()), pa.array(columns, pa.int32()), pa.array(digests, pa.binary())], ["ctx", "column", "window"])


def _bits(batches):
    """(ctx, found) from (ctx, columns)."""
    for batch in batches:
        out = np.zeros((batch.num_rows, SPAN), dtype=bool)
        for i, columns in enumerate(batch.column(1).to_pylist()):
            out[i, columns] = True
        yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in np.packbits(out, axis=1)], pa.binary())], ["ctx", "found"])


def repeated_windows(docs: DataFrame, shard_contexts: int = SHARD_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(places, found): (ctx, rid, places) of the anchors, and (ctx, found) bits of the windows that are repeated."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    every = cut(docs.mapInArrow(_anchor_rows, "gram long, rid long, place long, more binary"), "anchors")
    often = every.groupBy("gram").agg(F.sum(F.lit(1) + F.coalesce(F.length("more") / 16, F.lit(0))).alias("n"), F.count(F.lit(1)).alias("m")).filter("n >= 2")
    # a string with more than one row in HOT of all is one of HOT at most: these meet their rows by broadcast, all others by a join
    bound = every.count() // HOT + 1
    often = cut(often.select("gram", (F.col("m") > bound).alias("hot")), "often")
    hot = F.broadcast(often.filter("hot").select("gram"))
    found = every.join(hot, "gram", "left_anti").join(often.filter("not hot").select("gram"), "gram").unionAll(every.join(hot, "gram")).mapInArrow(_unpacked, "gram long, rid long, places binary")
    per_row = found.groupBy("rid").agg(F.collect_list(F.struct("gram", "places")).alias("found"))
    packed = docs.mapInArrow(_packed_rows, f"doc_id {kind}, rid long, packed binary").select("rid", "packed")
    rows = cut(packed.join(per_row, "rid").select("rid", "packed", "found").mapInArrow(_context_rows, "ctx binary, gram long, bytes binary, before int, n long, rid long, places binary"), "contexts")
    contexts, places = rows.filter(F.col("bytes").isNotNull()).drop("rid", "places"), rows.filter(F.col("bytes").isNull()).select("ctx", "rid", "places")
    sizes = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("m"))
    total = contexts.count()
    shards = max(8, total // min(COMMON_SHARD, shard_contexts))
    hot = sizes.filter(F.col("m") > shard_contexts)
    salted = contexts.join(hot, "gram", "left").withColumn("salts", F.coalesce(F.ceil(F.col("m") / shard_contexts), F.lit(1)).cast("int"))
    salt = F.pmod(F.xxhash64("ctx"), F.col("salts")).cast("int")
    # a hot string's salts are shards of their own
    shard = F.struct(F.when(F.col("salts") > 1, F.col("gram")).otherwise(F.pmod(F.xxhash64("gram"), F.lit(shards))).alias("a"), F.when(F.col("salts") > 1, salt).otherwise(-1).alias("b"))
    dealt = salted.select(shard.alias("shard"), "ctx", "bytes", "before", "n", "salts")
    found = cut(dealt.select("shard", "ctx", "bytes", "before", "n").groupBy("shard").applyInArrow(_shard(f"{shared_dir(docs.sparkSession)}/sparsewright"), "ctx binary, found binary, lead binary"), "windows")
    if hot.isEmpty():
        return places, found.select("ctx", "found")
    # salts of one string: their leading windows meet by hash
    rest = dealt.filter("salts > 1").select("ctx", "bytes", "before").join(found.select("ctx", "lead"), "ctx").dropDuplicates(["ctx"])
    windows = cut(rest.select("ctx", "bytes", "before", "lead").mapInArrow(_window_rows, "ctx binary, column int, window binary"), "windows")
    twice = windows.groupBy("window").count().filter("count >= 2").select("window")
    more = windows.join(twice, "window").groupBy("ctx").agg(F.collect_set("column").alias("columns")).mapInArrow(_bits, "ctx binary, found binary")
    return places, found.select("ctx", "found").unionAll(more)


def _finish(batches):
    """Of (doc_id, packed, marks, n_shared_strings): the digest columns, the removed spans and the last."""
    unpack = zstandard.ZstdDecompressor().decompress
    none = np.zeros(0, dtype=np.int64)
    for batch in batches:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "begins", "ends")}
        for packed, marks in zip(batch.column(1), batch.column(2), strict=True):
            text = unpack(packed.as_py())
            begin, end = removed_spans(len(text), marks.as_py()) if marks.is_valid else (none, none)
            kept, last, view = hashlib.sha256(), 0, memoryview(text)
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                kept.update(view[last:b])
                last = e
            kept.update(view[last:])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int((end - begin).sum()))
            out["n_spans"].append(len(begin))
            out["kept_sha256"].append(kept.hexdigest())
            out["begins"].append(begin)
            out["ends"].append(end)
        yield pa.record_batch([batch.column(0), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["begins"], pa.list_(pa.int64())), pa.array(out["ends"], pa.list_(pa.int64())), batch.column(3)], ["doc_id", *out, "n_shared_strings"])


def _binary(rows) -> pa.Array:
    return pa.array([np.ascontiguousarray(r).tobytes() for r in rows], pa.binary())


def _string_rows(batches):
    """A row a batch: its rows' keys, and (string, row) pairs."""
    for batch in batches:
        strings, rows, keys = [], [], []
        for part in slices(batch):
            texts = texts_of(part.column(1))
            text, h = word_strings(Slice(texts))
            strings.append(h)
            rows.append((text + len(keys)).astype(np.uint32))
            keys += [row_key(t, i) for t, i in zip(texts.to_pylist(), part.column(0).to_pylist(), strict=True)]
        if strings:
            yield pa.record_batch([pa.array([uuid.uuid4().hex]), *(_binary([x]) for x in (np.array(keys, dtype=np.int64), np.concatenate(strings), np.concatenate(rows)))], ["batch", "keys", "strings", "rows"])


def _bucket_rows(buckets: int):
    def run(batches):
        """(bucket, batch, strings, n): a batch's distinct strings by bucket of their hash, with the number of its rows that have each."""
        for batch in batches:
            for name, strings in zip(batch.column("batch").to_pylist(), batch.column("strings").to_pylist(), strict=True):
                string, n = np.unique(np.frombuffer(strings, dtype=U64), return_counts=True)
                bucket = ((string >> U64(20)) % U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                begin = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)[: len(bucket)])
                parts = [np.split(x[order], begin[1:]) if len(begin) else [] for x in (string, n.astype(np.int32))]
                yield pa.record_batch([pa.array(bucket[order][begin]), pa.array([name] * len(begin), pa.string()), _binary(parts[0]), _binary(parts[1])], ["bucket", "batch", "strings", "n"])

    return run


def _often(table: pa.Table) -> pa.Table:
    """Of a bucket: each batch's strings that two rows or more of all batches have."""
    strings = [np.frombuffer(x, dtype=U64) for x in table.column("strings").to_pylist()]
    n = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in table.column("n").to_pylist()])
    _, inverse = np.unique(np.concatenate(strings), return_inverse=True)
    twice = np.split((np.bincount(inverse, weights=n) >= 2)[inverse], np.cumsum([len(s) for s in strings])[:-1])
    return pa.table({"batch": table.column("batch"), "strings": _binary([s[k] for s, k in zip(strings, twice, strict=True)])}).filter(pa.array([bool(k.any()) for k in twice]))


def _shared_rows(batches):
    """(rid, n_shared_strings) of the rows of a batch that have some."""
    for batch in batches:
        for keys, strings, rows, often in zip(*(batch.column(c).to_pylist() for c in ("keys", "strings", "rows", "often")), strict=True):
            known = np.concatenate([np.frombuffer(x, dtype=U64) for x in often])
            row = np.frombuffer(rows, dtype=np.uint32)[np.isin(np.frombuffer(strings, dtype=U64), known)]
            some, n = np.unique(row, return_counts=True)
            yield pa.record_batch([pa.array(np.frombuffer(keys, dtype=np.int64)[some]), pa.array(n)], ["rid", "n_shared_strings"])


def shared_strings(docs: DataFrame) -> DataFrame:
    """(rid, n_shared_strings) of the rows that have some. A string is one entry a batch and bucket, however many rows have it."""
    held = cut(docs.select("doc_id", "text").mapInArrow(_string_rows, "batch string, keys binary, strings binary, rows binary"), "strings")
    buckets = max(8, (held.agg(F.sum(F.length("strings"))).first()[0] or 0) // 8 // BUCKET_STRINGS)
    dealt = held.select("batch", "strings").mapInArrow(_bucket_rows(buckets), "bucket int, batch string, strings binary, n binary")
    often = dealt.groupBy("bucket").applyInArrow(_often, "batch string, strings binary").groupBy("batch").agg(F.collect_list("strings").alias("often"))
    found = held.join(often, "batch").mapInArrow(_shared_rows, "rid long, n_shared_strings long")
    return found.groupBy("rid").agg(F.max("n_shared_strings").alias("n_shared_strings"))


def removed_spans(size: int, marks: list) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the maximal removed runs of a text; marks: (places, bits) of its contexts."""
    starts = [(np.frombuffer(m["places"], dtype=np.int64)[:, None] + np.flatnonzero(np.unpackbits(np.frombuffer(m["found"], dtype=np.uint8))[:SPAN]) - (SPAN - 1)).ravel() for m in marks]
    start = np.concatenate(starts)
    start = np.unique(start[(start >= 0) & (start + LENGTH <= size)])
    if not len(start):
        return start, start
    # windows that touch or overlap are one run
    apart = np.flatnonzero(np.diff(start) > LENGTH)
    return start[np.append(0, apart + 1)], start[np.append(apart, len(start) - 1)] + LENGTH


def removals(docs: DataFrame, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, begins, ends, n_shared_strings): removed byte spans of every text, and its strings that tell of shared passages."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    places, found = repeated_windows(docs, shard_contexts)
    empty = F.lit(bytes(-(-SPAN // 8)))
    marks = places.join(found.filter(F.col("found") != empty), "ctx").groupBy("rid").agg(F.collect_list(F.struct("places", "found")).alias("marks"))
    packed = docs.mapInArrow(_packed_rows, f"doc_id {kind}, rid long, packed binary")
    rows = packed.join(marks, "rid", "left").join(shared_strings(docs), "rid", "left").select("doc_id", "packed", "marks", F.coalesce("n_shared_strings", F.lit(0)).cast("long").alias("n_shared_strings"))
    return rows.mapInArrow(_finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, begins array<long>, ends array<long>, n_shared_strings long")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("begins", "ends")
