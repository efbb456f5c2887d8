"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is
built. A text is parsed greedily into the longest phrases that occur in the
sample: the fewer phrases a character it needs, the closer the language. The
automaton is a dense table whose entry also says whether the step begins a new
phrase, and texts are parsed side by side in blocks of ``BLOCK`` characters, one
character of every block at a step.

Characters are lower-cased letters; runs of anything else are one space.

Cases: a null text, or one without a letter, is ``und`` with score 0; ties go
to the language that sorts first; without labelled rows all are ``und``;
repeated rows are told alike; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.llm.sampling import bounded, held_out, remainder
from sparsewright.llm.vec import slices, texts_of

SAMPLE_DOCS = 40
TRAIN_CHARS = 24_000
#: Labels that are learned at most: the model's size is this many tables. More are an error, not a silent cut.
MAX_LANGUAGES = 200
BLOCK = 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for code points that are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def clean(text: str) -> str:
    """Lower-cased letters with one space for each run of anything else."""
    low = text.lower()
    points = code_points(low)
    inside = _letters()[points]
    out = np.where(inside, points, np.uint32(32))
    blank = ~inside
    return out[~(blank & np.append(False, blank[:-1]))].tobytes().decode("utf-32-le", "surrogatepass")


class SuffixAutomaton:
    """All substrings of a text of small numbers."""

    def __init__(self, text):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new


def step_table(automaton: SuffixAutomaton, symbols: int) -> np.ndarray:
    """Flat table over (state * symbols + symbol) of (next state * symbols) * 2 + (1 if a phrase begins).

    Symbol 0 is padding (no step), symbol 1 a character outside the alphabet.
    State 0 has read nothing: what it reads begins a phrase.
    """
    table = np.zeros((len(automaton.next), symbols), dtype=np.int32)
    restart = np.ones(symbols, dtype=np.int32)
    restart[0] = 0
    for c, to in automaton.next[0].items():
        restart[c] = 2 * to * symbols + 1
    table[:] = restart
    for s, out in enumerate(automaton.next):
        if s:
            for c, to in out.items():
                table[s, c] = 2 * to * symbols
    return table.ravel()


def _parsed(table: np.ndarray, steps: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Phrases that end in each block of the whole texts' parses.

    All blocks are parsed side by side from the root first. Then a block that
    follows another of its text starts in the state that the other ended in, and
    is parsed anew until both parses are in one state, from where they are equal;
    so on while ends of blocks change.
    """
    state = np.zeros(steps.shape[1], dtype=np.int32)
    count = np.zeros(steps.shape[1], dtype=np.int32)
    states, counts = np.empty(steps.shape, dtype=np.int32), np.empty(steps.shape, dtype=np.int32)
    for i, c in enumerate(steps):
        value = table[state + c]
        count = count + (value & 1)
        state = value >> 1
        states[i], counts[i] = state, count
    ends, begins = states[-1].copy(), np.zeros(steps.shape[1], dtype=np.int32)
    follows = np.append(False, owner[1:] == owner[:-1])
    lanes = np.flatnonzero(follows)
    while len(lanes := lanes[ends[lanes - 1] != begins[lanes]]):
        state = begins[lanes] = ends[lanes - 1]
        count = np.zeros(len(lanes), dtype=np.int32)
        for i, c in enumerate(steps):
            value = table[state + c[lanes]]
            count = count + (value & 1)
            state = value >> 1
            met = state == states[i, lanes]
            if met.any():
                done = lanes[met]
                counts[i:, done] += count[met] - counts[i, done]
                lanes, state, count = lanes[~met], state[~met], count[~met]
                if not len(lanes):
                    break
            states[i, lanes], counts[i, lanes] = state, count
        ends[lanes] = state[: len(lanes)]
        lanes = lanes[lanes + 1 < len(owner)] + 1
        lanes = lanes[follows[lanes]]
    return counts[-1]


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray
    tables: list[np.ndarray]

    @classmethod
    def of(cls, samples: dict[str, str]) -> Model:
        """samples: cleaned text of each language."""
        alphabet = np.unique(np.concatenate([code_points(t) for t in samples.values()])) if samples else np.zeros(0, dtype=np.uint32)
        symbols = len(alphabet) + 2
        languages = sorted(samples)
        tables = [step_table(SuffixAutomaton((np.searchsorted(alphabet, code_points(samples[x])) + 2).tolist()), symbols) for x in languages]
        return cls(languages, alphabet, tables)

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each text by language, characters); 0 characters for a text without a letter."""
        lows = [(t or "").lower() for t in texts]
        size = np.array([len(t) for t in lows], dtype=np.int64)
        points = code_points("".join(lows))
        inside = _letters()[points]
        doc = np.repeat(np.arange(len(lows)), size)
        blank = ~inside
        twice = blank.copy()
        twice[1:] &= blank[:-1] & (doc[1:] == doc[:-1])
        twice[:1] = False
        keep = ~twice
        points, doc, inside = np.where(inside, points, np.uint32(32))[keep], doc[keep], inside[keep]
        letters = np.bincount(doc[inside], minlength=len(lows))
        n = np.bincount(doc, minlength=len(lows))
        if not len(points) or not self.languages:
            return np.zeros((len(lows), len(self.languages))), np.zeros(len(lows), dtype=np.int64)
        slot = np.searchsorted(self.alphabet, points)
        slot[slot == len(self.alphabet)] = 0
        symbol = np.where(self.alphabet[slot] == points, slot + 2, 1)
        blocks = -(-n // BLOCK)
        first = np.cumsum(blocks) - blocks
        grid = np.zeros((int(blocks.sum()), BLOCK), dtype=np.int32)
        inner = np.arange(len(points)) - (np.cumsum(n) - n)[doc]
        grid[first[doc] + inner // BLOCK, inner % BLOCK] = symbol
        steps = np.ascontiguousarray(grid.T)
        out = np.zeros((len(lows), len(self.languages)))
        owner = np.repeat(np.arange(len(lows)), blocks)
        for k, table in enumerate(self.tables):
            out[:, k] = np.bincount(owner, weights=_parsed(table, steps, owner), minlength=len(lows))
        return out, np.where(letters > 0, n, 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score): the score is the second language's share of the phrases of the first two, from 0.5 to 1."""
        counts, n = self.phrases(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        rate = counts / np.maximum(n, 1)[:, None]
        order = np.argsort(rate, axis=1, kind="stable")
        rows = np.arange(len(texts))
        best = rate[rows, order[:, 0]]
        second = rate[rows, order[:, 1]] if len(self.languages) > 1 else np.ones(len(texts))
        score = np.where(n > 0, second / np.maximum(best + second, 1e-12), 0.0)
        return [self.languages[j] if k else UNKNOWN for j, k in zip(order[:, 0], n, strict=True)], score


def train(docs: DataFrame, modulus: int = 3, rest: int = 1, sample_docs: int = SAMPLE_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """Sample at most ``sample_docs`` documents with letters a language, by hash among all of them, and take whole ones, in order of hash, while they fit into ``train_chars``.

    What room they leave, of ``train_chars // sample_docs`` characters or more, is filled with
    pieces of the others, equally long ones. A text over ``train_chars`` gives a piece from a hashed place of its letters.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).filter(remainder(modulus) != rest)
    known = known.select("doc_id", "text", F.col("lang").alias("label")).filter(F.col("text").rlike(r"\p{L}"))
    picked, total = bounded(known.select("doc_id", "label"), "label", sample_docs)
    if len(total) > MAX_LANGUAGES:
        raise ValueError(f"{len(total)} labels in lang; at most {MAX_LANGUAGES} can be learned")
    low = F.regexp_replace("text", r"\P{L}+", " ")
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length(low) - train_chars + 1, F.lit(1))).cast("int") + 1
    long = F.length("text") > train_chars
    text = F.when(long, F.substring(low, place, F.lit(train_chars))).otherwise(F.col("text"))
    rows = known.join(F.broadcast(picked), ["doc_id", "label"]).select("doc_id", "label", long.alias("long"), text.alias("text")).collect()
    samples: dict[str, str] = {}
    others: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.label, xxhash.xxh64_intdigest(str(r.doc_id)), r.text)):
        held, more = samples.get(r.label, ""), clean(r.text).strip()
        if more and not r.long and len(held) + 1 + len(more) <= max(train_chars, len(more)):
            samples[r.label] = f"{held} {more}" if held else more
        elif more:
            others.setdefault(r.label, []).append(more)
    least = max(1, train_chars // sample_docs)
    for label, texts in others.items():
        held = samples.get(label, "")
        room = train_chars - len(held)
        count = min(len(texts), room // least)
        if count:
            samples[label] = " ".join([*([held] if held else []), *(t[: max(1, room // count - 1)] for t in texts[:count])])
    return Model.of(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_LANGUAGES and TRAIN_CHARS
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [x.decode() for x in texts_of(part.column(1)).to_pylist()]
                names, score = held.value.predict(texts)
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = predict(docs, train(docs))
    return told.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
