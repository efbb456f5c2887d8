"""Anchors between two sets of cells, and what is carried along them: labels, values, corrections, quality scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsewright.operators.neighbors import knn
from sparsewright.plans.scratch import cut


def four_way(a: DataFrame, b: DataFrame, k: int) -> dict[str, DataFrame]:
    """Neighbour tables aa, bb (k + 1, the cell itself included), ab and ba (k)."""
    return {"aa": knn(a, a, k + 1), "bb": knn(b, b, k + 1), "ab": knn(b, a, k), "ba": knn(a, b, k)}


def mutual_neighbors(ab: DataFrame, ba: DataFrame, k: int) -> DataFrame:
    """(cell1, cell2, score = 1): pairs within each other's k nearest."""
    one = ab.filter(F.col("rank") <= k).select(F.col("query").alias("cell1"), F.col("neighbor").alias("cell2"))
    two = ba.filter(F.col("rank") <= k).select(F.col("neighbor").alias("cell1"), F.col("query").alias("cell2"))
    return one.join(two, ["cell1", "cell2"]).withColumn("score", F.lit(1.0))


def filter_anchors(anchors: DataFrame, b_of_a: DataFrame, k_filter: int) -> DataFrame:
    """Anchors whose cell2 is among the k_filter neighbours of cell1 in another space."""
    near = b_of_a.filter(F.col("rank") <= k_filter).select(F.col("query").alias("cell1"), F.col("neighbor").alias("cell2"))
    return anchors.join(near, ["cell1", "cell2"], "left_semi")


def score_anchors(anchors: DataFrame, near: dict[str, DataFrame], k_score: int) -> DataFrame:
    """(cell1, cell2, score): shared neighbours of both ends, between the 1 % and 90 % quantiles rescaled to [0, 1]."""

    def side(same: str, other: str) -> DataFrame:
        # members of the two sets are told apart by the set they belong to
        s = near[same].filter(F.col("rank") <= k_score).select("query", F.lit(same[0]).alias("of"), "neighbor")
        o = near[other].filter(F.col("rank") <= k_score).select("query", F.lit(other[1]).alias("of"), "neighbor")
        return s.unionByName(o).distinct()

    one = side("aa", "ab").withColumnRenamed("query", "cell1")
    two = side("bb", "ba").withColumnRenamed("query", "cell2")
    pairs = anchors.select("cell1", "cell2")
    shared = pairs.join(one, "cell1").join(two, ["cell2", "of", "neighbor"]).groupBy("cell1", "cell2").agg(F.count(F.lit(1)).alias("s"))
    rows = pairs.join(shared, ["cell1", "cell2"], "left").select("cell1", "cell2", F.coalesce("s", F.lit(0)).cast("double").alias("s"))
    q = rows.agg(F.percentile("s", 0.01).alias("lo"), F.percentile("s", 0.9).alias("hi"))
    rows = rows.join(F.broadcast(q), how="cross")  # one row
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))).otherwise(1.0)
    return rows.select("cell1", "cell2", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)).alias("score"))


def find_anchors(a: DataFrame, b: DataFrame, k_anchor: int = 5, k_score: int = 30) -> DataFrame:
    near = four_way(a, b, max(k_anchor, k_score))
    return cut(score_anchors(mutual_neighbors(near["ab"], near["ba"], k_anchor), near, k_score), "anchors")


def anchor_weights(anchors: DataFrame, query: DataFrame, k_weight: int = 50, sd: float = 1.0) -> DataFrame:
    """(cell, cell1, cell2, weight): of each query cell, weights of the anchors at its nearest anchor cells, summing to 1.

    A near anchor cell counts once for each of its anchors, up to k_weight in order.
    """
    ends = query.join(anchors.select(F.col("cell2").alias("cell")).distinct(), "cell", "left_semi")
    near = knn(ends, query, k_weight)
    far = near.groupBy("query").agg(F.max("dist").alias("dk"))
    rows = near.join(far, "query").join(anchors.withColumnRenamed("cell2", "neighbor"), "neighbor")
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "cell1"))
    closeness = F.when(F.col("dk") > 0, 1 - F.col("dist") / F.when(F.col("dk") > 0, F.col("dk"))).otherwise(1.0)
    w = 1 - F.exp(-closeness * F.col("score") / (2.0 / sd) ** 2)
    rows = rows.withColumn("place", place).filter(F.col("place") <= k_weight).withColumn("w", w)
    total = F.sum("w").over(Window.partitionBy("query"))
    return rows.withColumn("t", total).filter("t > 0").select(F.col("query").alias("cell"), "cell1", F.col("neighbor").alias("cell2"), (F.col("w") / F.col("t")).alias("weight"))


def transfer_labels(weights: DataFrame, labels: DataFrame, floor: float = 0.0) -> DataFrame:
    """(cell, predicted, score): the reference label of the largest weight; first of ties in order; ``Unassigned`` below the floor."""
    rows = weights.join(labels.select(F.col("cell").alias("cell1"), "label"), "cell1").groupBy("cell", "label").agg(F.sum("weight").alias("score"))
    first = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc(F.round("score", 9)), "label"))
    best = rows.withColumn("k", first).filter("k = 1")
    name = F.when(F.col("score") < floor, "Unassigned").otherwise(F.col("label").cast("string"))
    return best.select("cell", name.alias("predicted"), "score")


def transfer_values(weights: DataFrame, values: DataFrame) -> DataFrame:
    """(cell, feature, value): weighted reference values."""
    return weights.join(values.withColumnRenamed("cell", "cell1"), "cell1").groupBy("cell", "feature").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def correct(weights: DataFrame, reference: DataFrame, query: DataFrame) -> DataFrame:
    """(cell, dim, value): query vectors less the weighted differences between anchors' query and reference ends. Both in long form (cell, dim, value)."""
    r = reference.select(F.col("cell").alias("cell1"), "dim", F.col("value").alias("v1"))
    q = query.select(F.col("cell").alias("cell2"), "dim", F.col("value").alias("v2"))
    shift = weights.join(r, "cell1").join(q, ["cell2", "dim"]).groupBy("cell", "dim").agg(F.sum(F.col("weight") * (F.col("v2") - F.col("v1"))).alias("shift"))
    return query.join(shift, ["cell", "dim"], "left").select("cell", "dim", (F.col("value") - F.coalesce("shift", F.lit(0.0))).alias("value"))


def long_form(vectors: DataFrame) -> DataFrame:
    return vectors.select("cell", F.posexplode("vector").alias("dim", "value"))


def vector_form(long: DataFrame) -> DataFrame:
    return long.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("p")).select("cell", F.col("p.value").alias("vector"))


def integrate(datasets: dict[str, DataFrame], k_anchor: int = 5, k_score: int = 30, k_weight: int = 50) -> DataFrame:
    """(cell, dim, value): all (cell, vector) sets corrected onto each other, the most alike first; the larger is the reference.

    The loop is over datasets, not over data.
    """
    sets = dict(datasets)
    sizes = {k: v.count() for k, v in sets.items()}
    names = sorted(sets)
    alike = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            near = four_way(sets[a], sets[b], k_anchor)
            alike[a, b] = mutual_neighbors(near["ab"], near["ba"], k_anchor).count() / min(sizes[a], sizes[b])
    group = {k: [k] for k in names}
    while len(group) > 1:
        keys = sorted(group)
        linkage = lambda x, y: min(alike.get((a, b), alike.get((b, a), 0.0)) for a in group[x] for b in group[y])  # noqa: E731, B023  complete linkage
        a, b = max(((x, y) for i, x in enumerate(keys) for y in keys[i + 1 :]), key=lambda p: linkage(*p))
        if sizes[b] > sizes[a]:
            a, b = b, a
        # written out: the next merge reads them many times over
        anchors = cut(find_anchors(sets[a], sets[b], k_anchor, k_score), "anchors")
        weights = cut(anchor_weights(anchors, sets[b], k_weight), "weights")
        fixed = vector_form(correct(weights, long_form(sets[a]), long_form(sets[b])))
        sets[a] = cut(sets[a].select("cell", "vector").unionByName(fixed), "integrated")
        sizes[a] += sizes[b]
        group[a] += group.pop(b)
        del sets[b]
    return long_form(next(iter(sets.values())))


def mixing_metric(neighbors: DataFrame, groups: DataFrame, k: int = 5, max_k: int = 300) -> DataFrame:
    """(cell, metric): median over groups of the rank of the k-th neighbour of that group, max_k if there are fewer."""
    labels = groups.select(F.col("cell").alias("neighbor"), "grp")
    w = Window.partitionBy("query", "grp").orderBy("rank")
    kth = neighbors.filter(F.col("rank") <= max_k).join(labels, "neighbor").withColumn("k", F.row_number().over(w)).filter(F.col("k") == k).select("query", "grp", "rank")
    grid = neighbors.select("query").distinct().join(groups.select("grp").distinct(), how="cross")
    rows = grid.join(kth, ["query", "grp"], "left").select("query", F.coalesce("rank", F.lit(max_k)).cast("double").alias("r"))
    return rows.groupBy(F.col("query").alias("cell")).agg(F.percentile("r", 0.5).alias("metric"))


def local_structure(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """(cell, share): share of a cell's k neighbours that stay."""
    a = before.filter(F.col("rank") <= k).select("query", "neighbor")
    kept = a.join(after.filter(F.col("rank") <= k).select("query", "neighbor"), ["query", "neighbor"]).groupBy("query").agg(F.count(F.lit(1)).alias("s"))
    return a.select("query").distinct().join(kept, "query", "left").select(F.col("query").alias("cell"), (F.coalesce("s", F.lit(0)) / float(k)).alias("share"))


def subset_anchors(anchors: DataFrame, threshold: float | None = None, disallowed: DataFrame | None = None) -> DataFrame:
    """Anchors with a score strictly above the threshold and outside the disallowed dataset pairs, either way round."""
    out = anchors if threshold is None else anchors.filter(F.col("score") > threshold)
    if disallowed is not None:
        both = disallowed.select("dataset1", "dataset2").unionByName(disallowed.select(F.col("dataset2").alias("dataset1"), F.col("dataset1").alias("dataset2")))
        out = out.join(both, ["dataset1", "dataset2"], "left_anti")
    return out


def annotate_anchors(anchors: DataFrame, cells: DataFrame, column: str) -> DataFrame:
    """Both ends' values of a cell column, and whether they match."""
    out = anchors
    for end in ("1", "2"):
        out = out.join(cells.select(F.col("cell").alias(f"cell{end}"), F.col(column).alias(f"{column}{end}")), f"cell{end}", "left")
    return out.withColumn(f"{column}_match", F.col(f"{column}1") == F.col(f"{column}2"))


def mapping_score(anchors: DataFrame, reference: DataFrame, query: DataFrame, k: int = 50, k_weight: int = 50) -> DataFrame:
    """(cell, score): how much of a query cell's neighbourhood survives projection to the reference and back, at most 1."""
    there = cut(anchor_weights(anchors, query, k_weight), "weights")
    onto = vector_form(there.join(long_form(reference).withColumnRenamed("cell", "cell1"), "cell1").groupBy("cell", "dim").agg(F.sum(F.col("weight") * F.col("value")).alias("value")))
    back = vector_form(there.join(long_form(query).withColumnRenamed("cell", "cell2"), "cell2").groupBy("cell", "dim").agg(F.sum(F.col("weight") * F.col("value")).alias("value")))
    before, after = knn(query, query, k), knn(back, query, k)
    width = before.groupBy("query").agg(F.max("dist").alias("far"))
    kernel = lambda t: F.exp(-F.col(t) / F.col("far"))
    one = before.join(width, "query").groupBy("query").agg(F.avg(kernel("dist")).alias("p"))
    two = after.join(width, "query").groupBy("query").agg(F.avg(kernel("dist")).alias("q"))
    return one.join(two, "query").join(onto.select(F.col("cell").alias("query")), "query", "left_semi").select(F.col("query").alias("cell"), F.least(F.lit(1.0), F.try_divide("q", "p")).alias("score"))


def count_anchors(anchors: DataFrame, sizes: DataFrame) -> DataFrame:
    """(dataset1, dataset2, similarity): anchors of a pair of datasets over the smaller one's cells, from (dataset1, dataset2, ...) and (dataset, n)."""
    n = anchors.groupBy("dataset1", "dataset2").agg(F.count(F.lit(1)).alias("k"))
    for end in ("1", "2"):
        n = n.join(sizes.select(F.col("dataset").alias(f"dataset{end}"), F.col("n").alias(f"n{end}")), f"dataset{end}")
    return n.select("dataset1", "dataset2", (F.col("k") / F.least("n1", "n2")).alias("similarity"))


def map_query(reference: DataFrame, query: DataFrame, labels: DataFrame, k_anchor: int = 5, k_score: int = 30, k_weight: int = 50) -> tuple[DataFrame, DataFrame]:
    """(labels, vectors) of query cells: transferred labels and corrected vectors, by one table of anchor weights."""
    weights = cut(anchor_weights(find_anchors(reference, query, k_anchor, k_score), query, k_weight), "weights")
    return transfer_labels(weights, labels), vector_form(correct(weights, long_form(reference), long_form(query)))


def map_embeddings(anchors: DataFrame, reference: DataFrame, query: DataFrame, k_weight: int = 50) -> DataFrame:
    """(cell, vector): a query's embeddings corrected onto the reference's along given anchors."""
    weights = cut(anchor_weights(anchors, query, k_weight), "weights")
    return vector_form(correct(weights, long_form(reference), long_form(query)))


def bridge_anchors(reference: DataFrame, query: DataFrame, bridge_one: DataFrame, bridge_two: DataFrame, k_anchor: int = 5, k_score: int = 30) -> DataFrame:
    """Anchors between a reference of one kind and a query of another, through cells that were measured in both.

    ``bridge_one`` is of the query's kind and ``bridge_two`` of the reference's:
    the query is carried over by the linear map that fits the bridge best.
    """
    from sparsewright.operators.sketching import unsketch

    return find_anchors(reference, cut(unsketch(bridge_two, bridge_one, query), "bridged"), k_anchor, k_score)
