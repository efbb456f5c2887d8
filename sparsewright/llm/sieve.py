"""Bit sieves of ids: rows that a join by id cannot meet are told before their texts travel.

A sieve has one bit for each hash of an id, in words of 64 bits that go to all
executors. Its size is bounded: beyond it more rows than need be pass on to the
exact join that has to follow, never fewer.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsewright.llm.store import cut

#: Bits for an id, and at most for all.
ID_BITS, MOST_BITS = 16, 1 << 24


@dataclass
class Sieve:
    words: DataFrame
    bits: int

    @classmethod
    def of(cls, ids: DataFrame) -> Sieve:
        """Of the only column of ``ids``; a null is an id as any other."""
        ids = ids.select(F.col(ids.columns[0]).alias("id"))
        bits = min(MOST_BITS, 1 << max(6, (ids.count() * ID_BITS).bit_length()))
        made = cls(ids, bits)
        word, bit = made._place("id")
        rows = ids.select(word.alias("word"), bit.alias("bit")).select("word", F.expr("shiftleft(1L, bit)").alias("mask"))
        made.words = cut(rows.groupBy("word").agg(F.bit_or("mask").alias("bits")), "sieve")
        return made

    def _place(self, column: str) -> tuple[Column, Column]:
        place = F.pmod(F.xxhash64(F.col(column)), F.lit(self.bits))
        return F.shiftright(place, 6).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")

    def split(self, docs: DataFrame, column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
        """(rows whose id may be in the sieve, rows whose id is not)."""
        word, bit = self._place(column)
        own, at, bits = (f"__{x}_{uuid.uuid4().hex}" for x in ("word", "at", "bits"))  # no column of the rows has such a name
        flagged = docs.withColumn(at, bit).join(F.broadcast(self.words.withColumnsRenamed({"word": own, "bits": bits})), word == F.col(own), "left")
        held = F.expr(f"(shiftright(coalesce({bits}, 0L), {at}) & 1L) = 1L")
        return tuple(flagged.filter(x).select(*(F.col(f"`{c}`") for c in docs.columns)) for x in (held, ~held))
