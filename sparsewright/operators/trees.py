"""Merge trees of clusters or datasets. A tree is a list of merges (a, b, height); leaf i is node i, merge k is node n + k."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewright.operators.clustering import complete_linkage, descendants

Merges = list[tuple[int, int, float]]


def children(merges: Merges, n: int, node: int) -> tuple[int, ...]:
    """The two nodes that a merge joins; none for a leaf."""
    return () if node < n else tuple(merges[node - n][:2])


def left_leaves(merges: Merges, n: int, node: int) -> list[int]:
    return descendants(merges, n, children(merges, n, node)[0]) if node >= n else []


def right_leaves(merges: Merges, n: int, node: int) -> list[int]:
    return descendants(merges, n, children(merges, n, node)[1]) if node >= n else []


def internal_nodes(merges: Merges, n: int) -> list[int]:
    """All merges, the last (the root) first, each node before its children, left to right."""
    out, waiting = [], [n + len(merges) - 1] if merges else []
    while waiting:
        node = waiting.pop()
        if node >= n:
            out.append(node)
            waiting += reversed(children(merges, n, node))
    return out


def has_child(merges: Merges, n: int, node: int) -> bool:
    """Whether a child of the node is a merge itself."""
    return any(c >= n for c in children(merges, n, node))


def has_only_children(merges: Merges, n: int, node: int) -> bool:
    """Whether both children are merges."""
    found = children(merges, n, node)
    return bool(found) and all(c >= n for c in found)


def merged_node(cells: DataFrame, ident: str, names: list, merges: Merges, node: int) -> DataFrame:
    """``cells`` with all identities under a node relabelled as its first leaf."""
    under = [names[i] for i in descendants(merges, len(names), node)]
    return cells.withColumn(ident, F.when(F.col(ident).isin(under), F.lit(under[0])).otherwise(F.col(ident)))


def sample_tree(similarity: np.ndarray) -> Merges:
    """Complete linkage of datasets at distance 1 / similarity; none alike are infinitely far."""
    with np.errstate(divide="ignore"):
        distance = 1 / np.asarray(similarity, dtype=float)
    return complete_linkage(np.where(np.isfinite(distance), distance, np.finfo(float).max / 4))


def adjusted(merges: Merges, n: int, names: list[int]) -> Merges:
    """Leaves renamed to their numbers among all datasets; merges are numbered on from the largest."""
    top = max(names) + 1
    move = lambda x: names[x] if x < n else top + x - n
    return [(move(a), move(b), h) for a, b, h in merges]


def parsed_node(merges: Merges, n: int, node: int) -> str:
    """A leaf's number with a minus sign from 1, a merge's number from 1."""
    return str(-(node + 1)) if node < n else str(node - n + 1)


def parsed_merge(merges: Merges, n: int, k: int) -> tuple[str, str]:
    """Both sides of the k-th merge in that notation."""
    return parsed_node(merges, n, merges[k][0]), parsed_node(merges, n, merges[k][1])


def integration_order(merges: Merges, n: int) -> list[int]:
    """All datasets in the order that the tree's last merge brings them together, left to right."""
    return descendants(merges, n, n + len(merges) - 1) if merges else list(range(n))
