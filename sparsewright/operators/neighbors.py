"""Nearest neighbours, neighbour graphs and what is computed along them.

Exact search compares all queries with all references, but none is sent more
than once: the references are written to the shared folder, and a task goes
through them block by block with its queries and the k nearest so far. No task
holds more than two blocks and no pair list is made; the result is written, so
that no reader repeats the search.
``knn_buckets`` searches random-projection buckets instead, as many as a measured
recall asks for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsewright.functions.scalar import euclidean, l2_normalize
from sparsewright.plans.scratch import cut, parts, written

BLOCK = 2048
#: Queries whose exact neighbours tell how many buckets must be probed.
SAMPLE_QUERIES = 256


def _searcher(k: int):
    """Function of a cogroup: the k nearest references of each query of the group."""

    def nearest(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "neighbor": [], "dist": []})
        b = b.sort_values("ref", kind="stable")
        x, y, ids = np.stack(a["vector"].to_numpy()), np.stack(b["ref_vector"].to_numpy()), b["ref"].to_numpy()
        yy = (y * y).sum(axis=1)
        m, out = min(len(y), k), []
        wide = min(len(y), m + 16)
        for lo in range(0, len(x), 128):
            part = x[lo : lo + 128]
            rough = yy - 2 * (part @ y.T)
            some = np.broadcast_to(np.arange(len(y)), rough.shape) if wide == len(y) else np.sort(np.argpartition(rough, wide - 1, axis=1)[:, :wide], axis=1)
            d = np.sqrt(((y[some] - part[:, None]) ** 2).sum(axis=2))
            order = np.lexsort((some, d), axis=-1)[:, :m]
            best, dist = np.take_along_axis(some, order, 1), np.take_along_axis(d, order, 1)
            if wide < len(y):  # ties at the edge must all be seen
                held = np.sort(np.take_along_axis(rough, some, 1), axis=1)
                limit = held[:, m - 1] + 1e-9 * (1 + (part * part).sum(axis=1))
                for i in np.flatnonzero(held[:, -1] <= limit):
                    tied = np.flatnonzero(rough[i] <= limit[i])
                    e = np.sqrt(((y[tied] - part[i]) ** 2).sum(axis=1))
                    order = np.lexsort((tied, e))[:m]
                    best[i], dist[i] = tied[order], e[order]
            out.append(pd.DataFrame({"query": np.repeat(a["cell"].to_numpy()[lo : lo + 128], m), "neighbor": ids[best.ravel()], "dist": dist.ravel()}))
        return pd.concat(out)

    return nearest


def knn(reference: DataFrame, query: DataFrame | None = None, k: int = 20, metric: str = "euclidean") -> DataFrame:
    """(query, neighbor, rank, dist) of the k nearest of each query among (cell, vector); itself included if it is there; ties by id."""
    query = reference if query is None else query
    if metric == "cosine":
        unit = reference.withColumn("vector", l2_normalize(F.col("vector")))
        reference, query = unit, unit if query is reference else query.withColumn("vector", l2_normalize(F.col("vector")))
    elif metric != "euclidean":
        raise ValueError(f"unknown metric: {metric}")
    kind, asked = reference.schema["cell"].dataType.simpleString(), query.schema["cell"].dataType.simpleString()
    own = query is reference
    path = written(reference.select("cell", "vector").mapInArrow(_packed, f"cells array<{kind}>, vectors binary"), "references")
    if own:  # read back, as what made them can be long
        query = reference.sparkSession.read.schema(f"cells array<{kind}>, vectors binary").parquet(path).mapInArrow(_unpacked, f"cell {kind}, vector array<double>")
    else:
        query = cut(query.select("cell", "vector"), "queries")
    tasks = max(1, -(-query.count() // BLOCK))
    found = query.repartition(tasks, "cell").mapInArrow(_nearest(path, k), f"query {asked}, neighbor {kind}, rank int, dist double")
    return cut(found, "neighbors")


def _packed(batches):
    """Cells and vectors in blocks: a row has the cells of a block and their vectors' bytes."""
    for t in _gathered(batches):
        x = _matrix(t.column("vector"))
        yield pa.record_batch([pa.array([t.column("cell").to_pylist()], pa.list_(t.schema.field("cell").type)), pa.array([x.tobytes()], pa.binary())], ["cells", "vectors"])


def _unpacked(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            cells = batch.column("cells").slice(i, 1).flatten()
            x = np.frombuffer(batch.column("vectors")[i].as_buffer()).reshape(len(cells), -1)
            yield pa.record_batch([cells, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["cell", "vector"])


def _gathered(batches):
    """The rows of small batches in tables of ``BLOCK``, the last may have fewer."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, BLOCK - n)
            held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
            if n == BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.ascontiguousarray(vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vectors), -1)


def _ids(cells: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = cells.to_numpy(zero_copy_only=False) if isinstance(cells, pa.Array) else cells.to_numpy()
    return x.astype(str) if x.dtype == object else x


def _reference_blocks(path: str):
    """(ids, vectors) of what ``_packed`` made, in blocks of ``BLOCK`` rows or somewhat more."""
    ids, vectors, n = [], [], 0
    for t in parts(path):
        for cells, raw in zip(t.column("cells"), t.column("vectors"), strict=True):
            ids.append(_ids(cells.values))
            vectors.append(np.frombuffer(raw.as_buffer()).reshape(len(ids[-1]), -1))
            n += len(ids[-1])
            if n >= BLOCK:
                yield np.concatenate(ids), np.concatenate(vectors)
                ids, vectors, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(vectors)


def _nearest(path: str, k: int) -> Callable:
    """Of queries: the k nearest references by distance to 9 digits, then id."""

    def run(batches):
        for t in _gathered(batches):
            x = _matrix(t.column("vector"))
            many, xx = len(x), (x * x).sum(axis=1)
            part = np.column_stack([x, np.ones(many)])
            # the k nearest so far, in no order; a query's k-th squared distance less its own norm
            at, ids, dist, limit = np.empty(0, np.int64), None, np.empty(0), np.full(many, np.inf)
            for names, y in _reference_blocks(path):
                ids = names[:0] if ids is None else ids
                other = np.vstack([-2 * y.T, (y * y).sum(axis=1)])
                new_at, new_to = [], []
                for low in range(0, many, 128):
                    rough = part[low : low + 128] @ other
                    most = limit[low : low + 128]
                    if np.isinf(most).any() and len(y) > k:
                        most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1])
                    # what could be equal in the ninth digit is kept
                    i, j = np.divmod(np.flatnonzero(rough <= (most + 4e-9 * (1 + np.abs(most) + xx[low : low + 128]))[:, None]), len(y))
                    new_at.append(i + low)
                    new_to.append(j)
                new_at, new_to = np.concatenate(new_at), np.concatenate(new_to)
                if not len(new_at):
                    continue
                exact = np.concatenate([np.sqrt(((y[new_to[a : a + 65536]] - x[new_at[a : a + 65536]]) ** 2).sum(axis=1)) for a in range(0, len(new_at), 65536)])
                at, ids, dist = np.concatenate([at, new_at]), np.concatenate([ids, names[new_to]]), np.concatenate([dist, exact])
                order = np.lexsort((ids, np.round(dist, 9), at))
                at, ids, dist = at[order], ids[order], dist[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                best = rank < k
                at, ids, dist, rank = at[best], ids[best], dist[best], rank[best]
                last = rank == k - 1
                limit[at[last]] = dist[last] ** 2 - xx[at[last]]
            if len(at):
                yield pa.record_batch([t.column("cell").combine_chunks().take(pa.array(at)), pa.array(ids), pa.array((rank + 1).astype(np.int32)), pa.array(dist)], ["query", "neighbor", "rank", "dist"])

    return run


def _probe_order(x: np.ndarray, centre: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Buckets of each vector by rising cost: the squared projections on the planes that lie between."""
    s = (x - centre) @ planes
    codes = (np.arange(1 << planes.shape[1])[:, None] >> np.arange(planes.shape[1])) & 1
    up, s = (s > 0).astype(float), s * s
    return np.argsort((s * (1 - up)) @ codes.T + (s * up) @ (1 - codes).T, axis=1, kind="stable")


def knn_buckets(reference: DataFrame, query: DataFrame, k: int = 20, recall: float = 0.95, seed: int = 11) -> DataFrame:
    """Approximate neighbours: the k nearest among the references in the buckets that a query probes.

    A bucket is the sign bits of a vector, less the references' mean, on random
    orthogonal directions; there are about sqrt(n) of them, 4096 at most. A query
    probes buckets by rising distance of the planes it must cross. How many is
    measured: of ``SAMPLE_QUERIES`` queries (by hash) the exact neighbours are
    found, and so many buckets are probed that they hold the share ``recall`` of
    these. A query whose buckets hold under k references probes on until they hold
    k. Where half of the buckets or more are needed (vectors without structure),
    they save nothing and the search is ``knn``.
    """
    n = reference.count()
    if not n:
        return knn(reference, query, k)
    dims = len(reference.select("vector").first()[0])
    bits = max(1, min(12, dims, round(np.log2(n) / 2)))
    planes = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, bits)))[0]
    centre = np.array([r[1] for r in reference.select(F.posexplode("vector")).groupBy("pos").agg(F.round(F.avg("col"), 9)).orderBy("pos").collect()])
    kind, asked = reference.schema["cell"].dataType.simpleString(), query.schema["cell"].dataType.simpleString()

    def own(frames):
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(bucket=_probe_order(np.stack(pdf["vector"].to_numpy()), centre, planes)[:, 0])

    refs = reference.select("cell", "vector").mapInPandas(own, f"cell {kind}, vector array<double>, bucket int")
    size = np.zeros(1 << bits, dtype=np.int64)
    for r in refs.groupBy("bucket").count().collect():  # 4096 rows at most
        size[r["bucket"]] = r["count"]

    some = query.select("cell", "vector").orderBy(F.xxhash64("cell"), "cell").limit(SAMPLE_QUERIES)
    local = {r["cell"]: r["vector"] for r in some.collect()}
    if not local:
        return knn(reference, query, k)
    order = dict(zip(local, _probe_order(np.array(list(local.values())), centre, planes), strict=True))
    true = knn(reference, query.join(F.broadcast(some.select("cell")), "cell", "left_semi"), k).join(refs.select(F.col("cell").alias("neighbor"), "bucket"), "neighbor")
    turn = np.sort([int(np.flatnonzero(order[r["query"]] == r["bucket"])[0]) for r in true.select("query", "bucket").collect()])
    probes = int(turn[int(np.ceil(recall * len(turn))) - 1]) + 1
    if 2 * probes >= len(size):
        return knn(reference, query, k)
    blocks = np.maximum(1, -(-size // BLOCK))

    def probed(frames):
        for whole in frames:
            for lo in range(0, len(whole), 256):
                pdf = whole.iloc[lo : lo + 256]
                turns = _probe_order(np.stack(pdf["vector"].to_numpy()), centre, planes)
                enough = (np.cumsum(size[turns], axis=1) < min(k, n)).sum(axis=1) + 1
                at, j = np.nonzero((np.arange(len(size)) < np.maximum(probes, enough)[:, None]) & (size[turns] > 0))
                bucket = turns[at, j]
                # a large bucket's references lie in several blocks: the query goes to each
                times = blocks[bucket]
                again = np.repeat(np.arange(len(at)), times)
                block = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                yield pd.DataFrame({"cell": pdf["cell"].to_numpy()[at[again]], "vector": pdf["vector"].to_numpy()[at[again]], "bucket": bucket[again], "block": block})

    nq = max(1, -(-query.count() * probes // (BLOCK * len(size))))
    left = query.select("cell", "vector").mapInPandas(probed, f"cell {asked}, vector array<double>, bucket int, block int")
    left = left.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(nq)).cast("int"))
    many = F.element_at(F.array(*map(F.lit, blocks.tolist())), F.col("bucket") + 1)
    right = refs.select(F.col("cell").alias("ref"), F.col("vector").alias("ref_vector"), F.col("bucket").alias("ref_bucket"), F.pmod(F.xxhash64("cell"), many).cast("int").alias("ref_block"))
    right = right.withColumn("ref_part", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    found = left.groupBy("bucket", "block", "part").cogroup(right.groupBy("ref_bucket", "ref_block", "ref_part")).applyInPandas(_searcher(k), f"query {asked}, neighbor {kind}, dist double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("dist", 9), "neighbor"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "neighbor", "rank", "dist")


def nn_graph(neighbors: DataFrame) -> DataFrame:
    """(i, j, w): binary adjacency of neighbour lists."""
    return neighbors.select(F.col("query").alias("i"), F.col("neighbor").alias("j"), F.lit(1.0).alias("w"))


def weighted_graph(neighbors: DataFrame) -> DataFrame:
    return neighbors.select(F.col("query").alias("i"), F.col("neighbor").alias("j"), F.col("dist").alias("w"))


def snn(neighbors: DataFrame, k: int, prune: float = 1 / 15) -> DataFrame:
    """(i, j, w): Jaccard index s / (2k - s) of neighbour lists, edges below ``prune`` dropped, self-edges kept."""
    a = neighbors.select(F.col("query").alias("i"), "neighbor")
    b = neighbors.select(F.col("query").alias("j"), "neighbor")
    shared = a.join(b, "neighbor").groupBy("i", "j").agg(F.count(F.lit(1)).alias("s"))
    w = F.col("s") / (F.lit(2.0 * k) - F.col("s"))
    return shared.select("i", "j", w.alias("w")).filter(F.col("w") >= prune)


def snn_width(edges: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """(cell, width): mean distance to the k neighbours of least non-zero shared weight, ties to the farther."""
    e = edges.filter("i != j and w > 0").join(vectors.select(F.col("cell").alias("i"), F.col("vector").alias("vi")), "i").join(vectors.select(F.col("cell").alias("j"), F.col("vector").alias("vj")), "j")
    e = e.withColumn("d", euclidean(F.col("vi"), F.col("vj")))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("w", F.desc("d"), "j"))
    return e.withColumn("r", rank).filter(F.col("r") <= k).groupBy(F.col("i").alias("cell")).agg(F.avg("d").alias("width"))


def predict_values(neighbors: DataFrame, values: DataFrame, drop_self: bool = True) -> DataFrame:
    """(cell, feature, value): mean of neighbours' values in long form (cell, feature, value), zeros included."""
    n = neighbors.filter("query != neighbor") if drop_self else neighbors
    size = n.groupBy("query").agg(F.count(F.lit(1)).alias("k"))
    sums = n.join(values.withColumnRenamed("cell", "neighbor"), "neighbor").groupBy("query", "feature").agg(F.sum("value").alias("s"))
    return sums.join(size, "query").select(F.col("query").alias("cell"), "feature", (F.col("s") / F.col("k")).alias("value"))


def neighbor_mean(neighbors: DataFrame, vectors: DataFrame, mean: Callable[[Column], Column] = F.avg) -> DataFrame:
    """(cell, vector): mean vector (or any aggregate, by dimension) of the neighbours, without the cell itself."""
    rows = neighbors.filter("query != neighbor").join(vectors.withColumnRenamed("cell", "neighbor"), "neighbor").select("query", F.posexplode("vector").alias("dim", "x"))
    means = rows.groupBy("query", "dim").agg(mean(F.col("x")).alias("x"))
    return means.groupBy(F.col("query").alias("cell")).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("p")).select("cell", F.col("p.x").alias("vector"))


def pair_distances(a: DataFrame, b: DataFrame, function: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """(i, j, dist) of all pairs by any function of two vectors; all pairs are the result. Blocks of one side meet blocks of the other."""
    ki, kj = a.schema["cell"].dataType.simpleString(), b.schema["cell"].dataType.simpleString()
    blocks = lambda rows, c: rows.groupBy(F.pmod(F.xxhash64("cell"), F.lit(max(1, rows.count() // 512))).alias(f"b{c}")).agg(F.collect_list("cell").alias(f"{c}s"), F.collect_list("vector").alias(f"v{c}"))
    left, right = cut(blocks(a, "i"), "left"), cut(blocks(b, "j"), "right")
    n = right.select("bj").distinct().orderBy("bj")
    pairs = left.withColumn("bj", F.explode(F.lit([r[0] for r in n.collect()]))).join(right, "bj")  # one number a block of 512 cells

    def run(frames):
        for pdf in frames:
            for i, x, j, y in zip(pdf["is"], pdf["vi"], pdf["js"], pdf["vj"], strict=True):
                x, y = np.stack(list(x)), np.stack(list(y))
                for c, v in zip(i, x, strict=True):
                    yield pd.DataFrame({"i": c, "j": list(j), "dist": [float(function(v, w)) for w in y]})

    return pairs.select("is", "vi", "js", "vj").mapInPandas(run, f"i {ki}, j {kj}, dist double")


def niche_counts(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, label, n): labels among each cell's neighbours, itself included."""
    return neighbors.join(labels.select(F.col("cell").alias("neighbor"), "label"), "neighbor").groupBy(F.col("query").alias("cell"), "label").agg(F.count(F.lit(1)).alias("n"))


def multimodal_neighbors(modalities: dict[str, DataFrame], k: int = 20, wide: int = 200) -> tuple[DataFrame, DataFrame]:
    """(weights, neighbours): each cell's weight of each of two modalities, and its k weighted nearest neighbours.

    A modality that predicts the cell's own vector better from its own
    neighbours than from the other's gets the larger weight.
    """
    names = sorted(modalities)
    vec = {m: modalities[m].select("cell", l2_normalize(F.col("vector")).alias("vector")) for m in names}
    near = {m: knn(vec[m], k=k) for m in names}
    scores = None
    widths = {}
    for m in names:
        other = next(x for x in names if x != m)
        nearest = near[m].filter("query != neighbor").groupBy(F.col("query").alias("cell")).agg(F.min("dist").alias("d0"))
        widths[m] = snn_width(snn(near[m], k), vec[m], k).join(nearest, "cell").select("cell", F.greatest(F.col("width") - F.col("d0"), F.lit(1e-12)).alias("sigma"), "d0")
        rows = vec[m].join(widths[m], "cell")
        for tag, source in (("within", m), ("cross", other)):
            mean = neighbor_mean(near[source], vec[m]).withColumnRenamed("vector", "p")
            d = F.greatest(euclidean(F.col("vector"), F.col("p")) - F.col("d0"), F.lit(0.0))
            rows = rows.join(mean, "cell").withColumn(tag, F.exp(-d / F.col("sigma"))).drop("p")
        ratio = F.least(F.lit(200.0), F.greatest(F.lit(0.0), F.col("within") / (F.col("cross") + 1e-4)))
        part = rows.select("cell", F.lit(m).alias("modality"), ratio.alias("score"))
        scores = part if scores is None else scores.unionByName(part)
    top = F.max("score").over(Window.partitionBy("cell"))
    e = F.exp(F.col("score") - F.col("top"))
    weights = scores.withColumn("top", top).withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(Window.partitionBy("cell"))).select("cell", "modality", "weight")
    pairs = None
    for m in names:
        one = knn(vec[m], k=wide).filter("query != neighbor").select("query", "neighbor")
        pairs = one if pairs is None else pairs.unionByName(one)
    pairs = pairs.distinct()
    total = None
    for m in names:
        v = vec[m].join(widths[m], "cell").join(weights.filter(F.col("modality") == m), "cell")
        rows = pairs.join(v.select(F.col("cell").alias("query"), F.col("vector").alias("a"), "sigma", "d0", "weight"), "query").join(vec[m].select(F.col("cell").alias("neighbor"), F.col("vector").alias("b")), "neighbor")
        d = F.greatest(euclidean(F.col("a"), F.col("b")) - F.col("d0"), F.lit(0.0))
        one = rows.select("query", "neighbor", (F.col("weight") * F.exp(-d / F.col("sigma"))).alias("w"))
        total = one if total is None else total.unionByName(one)
    total = total.groupBy("query", "neighbor").agg(F.sum("w").alias("w"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("w", 9)), "neighbor"))
    dist = F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - F.col("w")) / 2)))
    return weights, total.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "neighbor", "rank", dist.alias("dist"))
