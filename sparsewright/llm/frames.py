"""Documents with columns of any name: all but id and text travel as one struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "__rest"


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __rest): no other column's name can clash with an operator's own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.struct(*(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(others))).alias(REST)] if others else []
    return docs.select("doc_id", "text", *rest)


def restored(out: DataFrame, docs: DataFrame, text_changed: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs``, in order, of rows that came from ``packed``; n_chars follows a changed text. ``extra`` columns come last and replace any of their name."""
    extra = extra or {}
    place = {c: i for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    columns = []
    for c in docs.columns:
        if c in extra:
            continue
        if c in ("doc_id", "text"):
            columns.append(F.col(c))
        elif c == "n_chars" and text_changed:
            columns.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"{REST}.f{place[c]}").alias(c))
    return out.select(*columns, *(e.alias(k) for k, e in extra.items()))
