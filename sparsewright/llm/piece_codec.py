"""SentencePiece encoding with byte offsets, and decoding.

Encoding has three parts. ``Normalizer`` does what the model's normaliser
specification says: at each place the longest key of the compiled character
map (a double-array trie, stored in the model with its replacement strings) is
replaced, white space is collapsed and escaped as the specification asks, and
for every byte of the outcome the place in the original bytes is recorded.
``Segmenter`` joins the normalised characters by the model's pieces and scores.
The pieces, laid end to end over the normalised bytes, are then projected
through the alignment to byte spans of the original text.

Pair merging by pieces that never hold a space mark after another character
cannot cross such a place, so runs of space marks with the characters up to the
next one are segmented each; a slice's equal runs are one, and those met lately
are kept. Models of other kinds
(unigram, no byte pieces) are segmented by the library, as is their decoding.

Cases: a null text is an empty text and has no ids; repeated rows are encoded
each; a character outside the vocabulary becomes byte pieces or the unknown id,
as the model says, and its bytes share the character's span; an empty table
gives an empty result; further columns are ignored by the query and kept by
``encode``.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.llm.frames import packed, restored
from sparsewright.llm.vec import slices, texts_of

SPACE_MARK = "▁".encode()
#: Texts handed to the library at once, in bytes.
CHUNK = 1 << 18


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class CharMap:
    """The compiled character map: ``longest(bytes, at)`` gives the longest key's length and its replacement."""

    def __init__(self, blob: bytes):
        (n,) = struct.unpack_from("<I", blob) if blob else (0,)
        self.units = np.frombuffer(blob, dtype="<u4", count=n // 4, offset=4).tolist() if blob else []
        self.strings = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        if not self.units:
            return None
        found, units = None, self.units
        unit = units[0]
        node = unit >> 10 << ((unit & 1 << 9) >> 6)
        for i in range(at, len(text)):
            b = text[i]
            node ^= b
            unit = units[node]
            if unit & (1 << 31 | 255) != b:
                break
            node ^= unit >> 10 << ((unit & 1 << 9) >> 6)
            if unit >> 8 & 1:
                place = units[node] & (1 << 31) - 1
                found = i + 1 - at, self.strings[place : self.strings.index(b"\0", place)]
        return found


class Normalizer:
    """The model's normaliser, with the source place of every byte that it makes."""

    def __init__(self, model: bytes):
        spec, trainer = b"", b""
        for number, value in _fields(model):
            if number == 3:
                spec = value
            elif number == 2:
                trainer = value
        flags = {3: 1, 4: 1, 5: 1}
        blob = b""
        for number, value in _fields(spec):
            if number == 2:
                blob = value
            elif number in flags:
                flags[number] = value
        self.map = CharMap(blob)
        self.prefix, self.collapse, self.escape = bool(flags[3]), bool(flags[4]), bool(flags[5])
        self.suffix = any(number == 24 and value for number, value in _fields(trainer))

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised, align): byte i stems from align[i]; align has one entry more, the end."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        if not self.map.units and not self.collapse and self.escape and not self.suffix:
            return self._plain(text)
        return self._mapped(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """No character map and no collapsing: only spaces change, three bytes for one."""
        raw = np.frombuffer(text, dtype=np.uint8)
        width = np.where(raw == 32, 3, 1)
        align = np.append(np.repeat(np.arange(len(raw)), width), len(raw))
        out = text.replace(b" ", SPACE_MARK)
        if self.prefix:
            return SPACE_MARK + out, np.concatenate([np.zeros(3, dtype=np.int64), align])
        return out, align

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        pieces: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at)
            if hit is None:
                b = text[at]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                hit = n, text[at : at + n]
            pieces.append((hit[1], at, at + hit[0]))
            at += hit[0]
        if self.collapse:
            while pieces and not pieces[0][0].strip(b" "):
                pieces.pop(0)
        mark = SPACE_MARK if self.escape else b" "
        out, align, end = bytearray(), [], len(text)
        start = pieces[0][1] if pieces else len(text)
        if self.prefix and not self.suffix and pieces:
            out += mark
            align += [start] * len(mark)
        blank = self.collapse
        for made, begin, _ in pieces:
            while self.collapse and blank and made.startswith(b" "):
                made = made[1:]
            if not made:
                continue
            for b in made:
                one = mark if b == 32 else bytes([b])
                out += one
                align += [begin] * len(one)
            blank = made.endswith(b" ")
        if self.collapse:
            while out.endswith(mark):
                end = align[-len(mark)]
                del out[-len(mark) :], align[-len(mark) :]
        if self.prefix and self.suffix and pieces:
            out += mark
            align += [end] * len(mark)
        return bytes(out), np.array([*align, end], dtype=np.int64)


MARK = SPACE_MARK.decode()


class Segmenter:
    """Pieces of normalised text by pair merging: the best score first, the leftmost of equals; other characters become byte pieces.

    ``usable`` tells whether the model is of this kind. Runs up to ``LONG``
    characters are remembered, some ``KEPT`` of them in two generations, of which
    the one that was asked for longest ago goes; new ones of a slice are merged
    together, one merge of each a round.
    """

    LONG, KEPT = 32, 400_000
    _NORMAL, _BYTE, _PAIRS = 1, 6, 2

    def __init__(self, model: bytes):
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        #: Bytes that a piece stands for, the space mark as a space.
        self.surface: list[bytes] = []
        kind, kinds = 1, set()
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                text, sort = piece[1].decode(), piece.get(3, self._NORMAL)
                kinds.add(sort)
                if sort == self._NORMAL:
                    self.ids[text] = len(self.surface)
                    (self.scores[text],) = struct.unpack("<f", piece.get(2, bytes(4)))
                elif sort == self._BYTE:
                    self.bytes[int(text[3:5], 16)] = len(self.surface)
                self.surface.append(bytes([int(text[3:5], 16)]) if sort == self._BYTE else text.replace(MARK, " ").encode() if sort == self._NORMAL else b"")
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        # 1 normal, 2 unknown, 3 control, 6 byte: no user-defined or unused pieces
        self.usable = kind == self._PAIRS and len(self.bytes) == 256 and kinds <= {1, 2, 3, 6} and not inner
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.decimal = [str(i) for i in range(len(self.surface))]
        #: By id: its decimal with a comma, and the bytes that it stands for.
        self.commas, self.back = pa.array([f"{d},".encode() for d in self.decimal], pa.large_binary()), pa.array(self.surface, pa.large_binary())

    def merge(self, run: str) -> list[int]:
        symbols: list[str] = list(run)
        n, scores = len(symbols), self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(-scores[pair], i, pair) for i, pair in enumerate(map("".join, zip(symbols, symbols[1:]))) if pair in scores]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (more := pair + symbols[k]) in scores:
                    heapq.heappush(queue, (-scores[more], i, more))
            h = before[i]
            if h >= 0 and (more := symbols[h] + pair) in scores:
                heapq.heappush(queue, (-scores[more], h, more))
        out: list[int] = []
        for s in symbols:
            if s:
                one = self.ids.get(s)
                out += [one] if one is not None else [self.bytes[b] for b in s.encode()]
        return out

    def _tables(self) -> None:
        """Symbols' numbers, and (left, right) numbers of all merges with the rank of their score and the number they make."""
        symbols = sorted(self.scores.keys() | {c for p in self.scores for c in p})
        number = {s: i + 1 for i, s in enumerate(symbols)}
        #: Number of a character by its code point; 0 for those without merges.
        self.number = np.zeros(0x110000, dtype=np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.number[ord(s)] = i
        #: Id of a symbol by its number; -1 for those that are no piece.
        self.id_of = np.array([-1, *(self.ids.get(s, -1) for s in symbols)], dtype="<i4")
        rank = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = []
        for piece, score in self.scores.items():
            for k in range(1, len(piece)):
                left, right = number.get(piece[:k]), number.get(piece[k:])
                if left and right:
                    pairs.append((left << 32 | right, rank[score], number[piece]))
        self.pairs, self.ranks, self.made = (np.array(c, dtype=np.int64) for c in zip(*sorted(pairs), strict=True))

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, number made) of symbol pairs; of pairs that do not merge, a rank beyond all."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.where(hit, self.ranks[at], 1 << 40), self.made[at]

    def merge_many(self, runs: list[str]) -> list[bytes]:
        """Packed ids of runs of at most ``LONG`` characters."""
        if not hasattr(self, "pairs"):
            self._tables()
        n, size = len(runs), np.array([len(r) for r in runs])
        width = int(size.max())
        column = np.arange(width + 1)
        held = column < size[:, None]
        symbols = np.zeros(held.shape, dtype=np.int64)
        symbols[held] = self.number[np.frombuffer("".join(runs).encode("utf-32-le"), dtype="<u4")]
        strange = ((symbols == 0) & held).any(axis=1)
        follow = np.broadcast_to(column + 1, symbols.shape).copy()
        prior = np.broadcast_to(column - 1, symbols.shape).copy()
        none = 1 << 40
        rank, made = self._ranked(symbols[:, :-1], symbols[:, 1:])
        rank[column[:-1] >= size[:, None] - 1] = none
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(axis=1)
            more = rank[rows, at] < none
            rows, at = rows[more], at[more]
            gone = follow[rows, at]
            after = follow[rows, gone]
            held[rows, gone] = False
            symbols[rows, at] = now = made[rows, at]
            follow[rows, at] = after
            rank[rows, np.minimum(gone, width - 1)] = none
            prior[rows, np.minimum(after, width)] = at
            r, m = self._ranked(now, symbols[rows, np.minimum(after, width)])
            rank[rows, at], made[rows, at] = np.where(after < size[rows], r, none), m
            before = prior[rows, at]
            left = before >= 0
            some, place = rows[left], before[left]
            rank[some, place], made[some, place] = self._ranked(symbols[some, place], now[left])
        flat, ends = self.id_of[symbols[held]], np.cumsum(held.sum(axis=1))
        strange |= np.minimum.reduceat(flat, np.append(0, ends[:-1])) < 0
        packed, ends = flat.tobytes(), (4 * ends).tolist()
        out = [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i in np.flatnonzero(strange).tolist():
            out[i] = self._packed(runs[i])
        return out

    def _packed(self, run: str) -> bytes:
        return np.array(self.merge(run), dtype="<i4").tobytes()

    def _segmented(self, runs: list[bytes]) -> list[bytes]:
        """Packed ids of distinct runs; those up to ``LONG`` characters are known from then on."""
        known = self.known
        out = [known.get(r) for r in runs]
        asked, new = {}, []
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = self.older.get(runs[i])
            if out[i] is not None:
                asked[runs[i]] = out[i]
            elif len(text := runs[i].decode()) <= self.LONG:
                new.append((len(text), i, text))
            else:
                out[i] = self._packed(text)
        # those of like length share a matrix
        new.sort()
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            for (_, i, _), ids in zip(part, self.merge_many([t for _, _, t in part]), strict=True):
                out[i] = asked[runs[i]] = ids
        if len(known) + len(asked) > self.KEPT // 2:
            self.older, self.known = known, asked
        else:
            known.update(asked)
        return out

    def arrays(self, made: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids of some normalised texts, one after another, and the place of each text's first (one entry more, the end)."""
        data = b"".join(made)
        buf = np.frombuffer(data, dtype=np.uint8)
        at = np.cumsum([0, *map(len, made)])
        mark = np.zeros(len(buf), dtype=bool)
        one, two, three = SPACE_MARK
        mark[:-2] = (buf[:-2] == one) & (buf[1:-1] == two) & (buf[2:] == three)
        fresh = mark.copy()
        fresh[3:] &= ~mark[:-3]
        fresh[at[:-1][np.diff(at) > 0]] = True
        begin = np.flatnonzero(fresh)
        if not len(begin):
            return np.zeros(0, dtype="<i4"), np.zeros(len(at), dtype=np.int64)
        edges = pa.py_buffer(np.append(begin, len(buf)).astype(np.int64))
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, edges, pa.py_buffer(data)]).dictionary_encode()
        packed = self._segmented(runs.dictionary.to_pylist())
        flat, size = np.frombuffer(b"".join(packed), dtype="<i4"), np.array([len(x) for x in packed]) // 4
        of = runs.indices.to_numpy()
        count = size[of]
        end = np.cumsum(count)
        ids = flat[np.arange(end[-1]) + np.repeat((np.cumsum(size) - size)[of] - (end - count), count)]
        return ids, np.append(0, end)[np.searchsorted(begin, at)]

    def __call__(self, made: list[str]) -> Iterator[list[int]]:
        """Ids of some texts."""
        ids, first = self.arrays([m.encode() for m in made])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield ids[a:b].tolist()


class Codec:
    """Ids of texts and texts of ids, and spans of the ids in the original bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(model)
        self.segment = Segmenter(model)
        n = self.model.get_piece_size()
        byte = np.array([self.model.is_byte(i) for i in range(n)])
        #: Bytes of the normalised text that an id covers; 0 for unknown, whose width the text tells.
        self.width = np.array([1 if byte[i] else len(self.model.id_to_piece(i).encode()) for i in range(n)], dtype=np.int64)
        self.unknown = self.model.unk_id()
        self.width[self.unknown] = 0

    def pieces(self, texts: list[str]) -> Iterator[tuple[list[int], str, str, np.ndarray]]:
        """(ids, the ids in decimal with commas, the decoded text, align) of each text; align as the normaliser gives it."""
        normal = [self.normalize(t.encode()) for t in texts]
        if self.segment.usable:
            decimal = self.segment.decimal
            for ids, (_, align) in zip(self.segment([m.decode() for m, _ in normal]), normal, strict=True):
                yield ids, ",".join([decimal[i] for i in ids]), self.decode(ids), align
            return
        for text, (_, align) in zip(texts, normal, strict=True):
            ids = self.model.encode(text, num_threads=1, add_bos=False, add_eos=False)
            yield ids, ",".join(map(str, ids)), self.model.decode(ids, num_threads=1), align

    def decode(self, ids: list[int]) -> str:
        surface = self.segment.surface
        if not self.segment.usable:
            return self.model.decode(ids, num_threads=1)
        return self.text_of(b"".join([surface[i] for i in ids]))

    def text_of(self, back: bytes) -> str:
        """The decoded text of pieces' bytes."""
        # the mark that the normaliser put before the text goes
        return (back[1:] if self.normalize.prefix and back[:1] == b" " else back).decode(errors="replace")

    def spans(self, text: str, ids: list[int], align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) bytes of the original text for each id."""
        if not len(ids):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        held = np.asarray(ids)
        width = self.width[held]
        if (held == self.unknown).any():
            width = self._with_unknown(text, ids)
        end = np.cumsum(width)
        if end[-1] != len(align) - 1:
            raise ValueError("pieces do not cover the normalised text")
        begin = end - width
        # a piece ends where the next begins; bytes of one source character share its span
        source = np.append(np.flatnonzero(np.diff(align)) + 1, len(align) - 1)
        last = align[source[np.searchsorted(source, end, side="left")]]
        return align[begin], last

    def _with_unknown(self, text: str, ids: list[int]) -> np.ndarray:
        """Widths where unknown pieces occur: the library tells their surfaces."""
        pieces = self.model.encode(text, out_type=str, num_threads=1)
        return np.array([1 if self.model.is_byte(i) else len(p.encode()) for i, p in zip(ids, pieces, strict=True)], dtype=np.int64)


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _run(batches, held, each, names, types):
    use = codec(held.value)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for part in slices(batch, CHUNK):
            texts = [x.decode() for x in texts_of(part.column(at)).to_pylist()]
            columns = each(use, texts)
            yield pa.record_batch([*part.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*part.schema.names, *names])


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with ``ids``, and with ``begins`` and ``ends``: the pieces' byte spans in the text."""
    docs = docs.drop("ids", "begins", "ends")
    held = docs.sparkSession.sparkContext.broadcast(read_model(model_path))  # a model file: some MB, whatever the data

    def each(use: Codec, texts: list[str]):
        ids, begins, ends = [], [], []
        for t, (found, _, _, align) in zip(texts, use.pieces(texts), strict=True):
            begin, end = use.spans(t, found, align)
            ids.append(found)
            begins.append(begin)
            ends.append(end)
        return ids, begins, ends

    def run(batches):
        return _run(batches, held, each, ["ids", "begins", "ends"], [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kept}, ids array<int>, begins array<long>, ends array<long>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the text of column ``ids`` (null: empty)."""
    encoded = encoded.drop("decoded")
    held = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        use = codec(held.value)
        for batch in batches:
            ids = [x or [] for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array([use.decode(i) for i in ids], pa.string())], [*batch.schema.names, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kept}, decoded string")


_DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256", "n_covered"]
_DIGEST_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64()]


def _covered(begin: np.ndarray, end: np.ndarray) -> int:
    """Bytes inside spans in order; those of one character's byte pieces coincide."""
    return int((end - np.maximum(begin, np.maximum.accumulate(np.append(0, end[:-1])))).clip(0).sum()) if len(end) else 0


def _joined(parts: pa.LargeBinaryArray, ids: np.ndarray, first: np.ndarray) -> list[memoryview]:
    """Of each text, the ids' parts laid end to end."""
    taken = parts.take(pa.array(ids))
    edge = np.frombuffer(taken.buffers()[1], dtype=np.int64)[first].tolist() if len(ids) else [0] * len(first)
    data = memoryview(taken.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _digest(use: Codec, texts: list[str]) -> list[list]:
    """Columns ``_DIGESTS`` of some texts."""
    rows = []
    if not use.segment.usable:
        for t, (ids, decimal, back, align) in zip(texts, use.pieces(texts), strict=True):
            rows.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), _covered(*use.spans(t, ids, align))))
    else:
        normal = [use.normalize(t.encode()) for t in texts]
        ids, first = use.segment.arrays([m for m, _ in normal])
        decimals, backs = _joined(use.segment.commas, ids, first), _joined(use.segment.back, ids, first)
        for t, (_, align), a, b, decimal, back in zip(texts, normal, first[:-1].tolist(), first[1:].tolist(), decimals, backs, strict=True):
            rows.append((b - a, hashlib.sha256(decimal[:-1]).hexdigest(), hashlib.sha256(use.text_of(bytes(back)).encode()).hexdigest(), _covered(*use.spans(t, ids[a:b], align))))
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in _DIGESTS]


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_covered): encode, align and decode in one pass, without shipping the ids.

    ``n_covered`` is the number of text bytes inside the projected spans; it is
    the text's length in bytes where the normaliser drops nothing.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        for out in _run(batches, held, _digest, _DIGESTS, _DIGEST_TYPES):
            yield out.drop_columns(["text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_covered long")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: digests, the covered bytes and the text's digest beside the documents' columns; no document goes."""
    held = spark.sparkContext.broadcast(read_model(default_model()))

    def run(batches):
        return _run(batches, held, _digest, _DIGESTS, _DIGEST_TYPES)

    rows = packed(docs)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(run, f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_covered long")
    return restored(out, docs, extra={c: F.col(c) for c in _DIGESTS} | {"text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)})
