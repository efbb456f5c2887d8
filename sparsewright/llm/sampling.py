"""Bounded training samples, dealt by hash: the same rows on every run, at any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1_000_000


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def held_out(modulus: int, rest: int):
    """True for the rows kept from learning; a null id is not held out (and has no label)."""
    return F.coalesce(remainder(modulus) == rest, F.lit(False))


def bounded(rows: DataFrame, by: str, bound: int) -> tuple[DataFrame, dict]:
    """At most ``bound`` rows for each value of ``by``, those of the lowest hash of doc_id, and the counts of all rows.

    A hash threshold from the counts thins the rows before any of them are
    ordered, so no task ever holds a whole class.
    """
    total = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    place = F.xxhash64(F.col("doc_id").cast("string"))
    parts = []
    for value, n in sorted(total.items(), key=lambda x: str(x[0])):
        if value is None:
            continue
        share = min(_STEPS, math.ceil(_STEPS * (bound + 4 * math.sqrt(bound)) / n))
        one = rows.filter((F.col(by) == value) & (F.pmod(place, F.lit(_STEPS)) < share))
        parts.append(one.orderBy(F.pmod(place, F.lit(_STEPS)), "doc_id").limit(bound))
    if not parts:
        return rows.limit(0), total
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out, total


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, bound: int) -> tuple[DataFrame, dict]:
    """(doc_id, text, label) of at most ``bound`` rows a class, none with remainder ``rest``; and the classes' sizes among all such rows.

    A document with several labels counts once, with the largest. The sample is
    broadcast to meet the texts: its size has the bound.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(remainder(modulus) != rest)
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    rows, total = bounded(known, "label", bound)
    kept = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return kept, total


def prior_shift(total: dict, positives: int, negatives: int) -> float:
    """What a balanced sample's log-odds miss of the classes' true sizes."""
    if not positives or not negatives:
        return 0.0
    return math.log(max(1, total.get(1, 0)) / max(1, total.get(0, 0))) - math.log(positives / negatives)
