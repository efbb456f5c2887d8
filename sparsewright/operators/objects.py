"""Verbs on identities, pieces and indices of a matrix, a graph or a set of anchors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsewright.functions.scalar import euclidean, relu
from sparsewright.matrix import Matrix
from sparsewright.operators.statistics import row_moments

OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {"-": lambda x, s: x - s, "+": lambda x, s: x + s, "*": lambda x, s: x * s, "/": F.try_divide}


def levels(cells: DataFrame, ident: str) -> DataFrame:
    """(level, place): the identities in use, in order."""
    found = cells.filter(F.col(ident).isNotNull()).select(F.col(ident).alias("level")).distinct()
    return found.withColumn("place", F.row_number().over(Window.orderBy("level")))


def with_levels(cells: DataFrame, ident: str, order: list) -> DataFrame:
    """``cells`` with ``place``: where the identity stands in ``order`` (from 1), null where it does not."""
    return cells.withColumn("place", F.nullif(F.array_position(F.lit(order), F.col(ident)), F.lit(0)))


def levels_by_feature(m: Matrix, ident: str, feature, descending: bool = False) -> DataFrame:
    """(level, mean, place): identities ordered by their cells' mean value of one feature, ties by name."""
    one = m.values.filter(F.col("feature") == feature).select("cell", "value")
    mean = m.cells.filter(F.col(ident).isNotNull()).join(one, "cell", "left").groupBy(F.col(ident).alias("level")).agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("mean"))
    by = F.desc("mean") if descending else F.asc("mean")
    return mean.withColumn("place", F.row_number().over(Window.orderBy(by, "level")))


def regroup(cells: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label): each cluster's most frequent label, the first in order of equals."""
    counts = cells.filter(F.col(label).isNotNull()).groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).count()
    first = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("count"), "label"))
    return counts.withColumn("k", first).filter("k = 1").select("cluster", "label")


def cells_by(cells: DataFrame, column: str) -> DataFrame:
    """(value, n, cell): every cell beside its image (or any other column's value) and the number of its cells."""
    return cells.filter(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.count(F.lit(1)).over(Window.partitionBy(column)).alias("n"), "cell")


def slim(m: Matrix, features: DataFrame | None = None, cells: DataFrame | None = None, columns: list[str] | None = None) -> Matrix:
    """Only the named features, cells and columns of the cells."""
    m = m if features is None else m.select_features(features)
    m = m if cells is None else m.select_cells(cells)
    return m if columns is None else Matrix(m.values, m.cells.select("cell", *columns), m.features)


def picked(m: Matrix, features: list, cells: list) -> DataFrame:
    """(feature, cell, value) of a given rectangle, zeros included."""
    spark = m.values.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in m.values.schema.fields}
    f = spark.createDataFrame([(x,) for x in features], f"feature {kinds['feature']}")
    c = spark.createDataFrame([(x,) for x in cells], f"cell {kinds['cell']}")
    grid = f.join(F.broadcast(c), how="cross")  # both are lists of the call
    return grid.join(m.values.join(F.broadcast(f), "feature"), ["feature", "cell"], "left").select("feature", "cell", F.coalesce("value", F.lit(0.0)).alias("value"))


def usable_features(m: Matrix, requested: DataFrame) -> DataFrame:
    """(feature): requested features that are present and vary."""
    return row_moments(m).join(requested.select("feature").distinct(), "feature", "left_semi").filter("variance > 0").select("feature")


def swept(values: DataFrame, stats: DataFrame, by: str, operation: str = "-") -> DataFrame:
    """Each stored value combined with the ``stat`` of its feature or cell; entries without one are left as they are."""
    rows = values.join(stats.select(by, "stat"), by, "left")
    done = OPERATIONS[operation](F.col("value"), F.col("stat"))
    return rows.select("feature", "cell", F.when(F.col("stat").isNull(), F.col("value")).otherwise(done).alias("value"))


def swept_dense(m: Matrix, stats: DataFrame, by: str, operation: str = "-") -> DataFrame:
    """The same on all pairs, zeros included."""
    return swept(m.dense(), stats, by, operation)


def interleaved(a: Column, b: Column) -> Column:
    """Elements of two arrays by turns; the longer one's rest follows."""
    return F.array_compact(F.flatten(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.array(p["x"], p["y"]))))


def empirical_p(values: DataFrame, null: DataFrame, value: str = "value") -> DataFrame:
    """``values`` with ``p``: the share of the null's values that are strictly greater. One sort of both; no pair of rows is made."""
    both = values.select(F.col(value).alias("v"), F.lit(0).alias("n")).distinct().unionAll(null.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    counts = both.groupBy("v").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1))
    shares = counts.select("v", F.try_divide(F.coalesce(above, F.lit(0)).cast("double"), F.sum("n").over(Window.partitionBy())).alias("p"))
    return values.join(shares, values[value] == F.col("v"), "left").drop("v")


def imputed_distance(x: Column, y: Column, nearest: Column) -> Column:
    """Euclidean distance beyond the nearest one, at least 0."""
    return relu(euclidean(x, y) - nearest)


def nth_largest(x: Column, n: int = 2) -> Column:
    """Aggregate: the n-th largest value, repeats counted; null if there are fewer."""
    return F.get(F.sort_array(F.collect_list(x), asc=False), n - 1)


def nth_largest_by(rows: DataFrame, by: str, value: str, n: int = 2) -> DataFrame:
    """(by, value): the same for groups of any size, as only n rows a group are kept."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value)))
    return rows.withColumn("k", place).filter(F.col("k") <= n).groupBy(by).agg(F.max(F.when(F.col("k") == n, F.col(value))).alias(value))


def longer_than(x: Column, cutoff: int = 0) -> Column:
    """Whether an array has more elements than the cutoff; null counts as none."""
    return F.coalesce(F.size(x), F.lit(0)) > cutoff


def is_empty(m: Matrix) -> bool:
    """Whether a matrix has no features or no cells."""
    return m.features.isEmpty() or m.cells.isEmpty()


def unused_name(taken: list[str], name: str) -> str:
    """``name``, or the first of name.1, name.2, ... that is not taken."""
    k, out = 0, name
    while out in taken:
        k += 1
        out = f"{name}.{k}"
    return out


def abbreviated(key: str, digits: bool = True) -> str:
    """A key's capitals (and digits) in lower case; the whole key where that is one character at most."""
    kept = "".join(c for c in key if "A" <= c <= "Z" or (digits and "0" <= c <= "9"))
    return (kept if len(kept) > 1 else key).lower()


def mapped(x: Column, values: dict) -> Column:
    """Dictionary lookup; what is not in the dictionary stays."""
    table = F.create_map(*(F.lit(v) for pair in values.items() for v in pair))
    return F.coalesce(F.try_element_at(table, x), x)


def dataset_offsets(sizes: DataFrame) -> DataFrame:
    """(dataset, first, size) from (dataset, size): places of the first cells of datasets that stand one after another."""
    before = F.sum("size").over(Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("dataset", F.coalesce(before, F.lit(0)).alias("first"), "size")


def with_datasets(anchors: DataFrame, sizes: DataFrame) -> DataFrame:
    """``anchors`` of global cell numbers with ``dataset1``, ``local1``, ``dataset2``, ``local2``. Datasets are a short list, joined by range."""
    offsets = dataset_offsets(sizes)
    out = anchors
    for k in ("1", "2"):
        o = F.broadcast(offsets.select(F.col("dataset").alias(f"dataset{k}"), F.col("first").alias("first"), F.col("size").alias("size")))
        out = out.join(o, (F.col(f"cell{k}") >= F.col("first")) & (F.col(f"cell{k}") < F.col("first") + F.col("size"))).withColumn(f"local{k}", F.col(f"cell{k}") - F.col("first")).drop("first", "size")
    return out


def cell_numbers(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cell, number): places, from 0, of wanted cells in the order of the names."""
    return names.select("cell", (F.row_number().over(Window.orderBy("cell")) - 1).alias("number")).join(wanted.select("cell"), "cell", "left_semi")


def quantile_scaled(rows: DataFrame, value: str, lower: float = 0.025, upper: float = 0.975) -> DataFrame:
    """``rows`` with the value moved and scaled so that the two quantiles become 0 and 1."""
    q = rows.agg(F.percentile(value, lower).alias("lo"), F.percentile(value, upper).alias("hi"))
    return rows.join(F.broadcast(q), how="cross").withColumn(value, F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))).drop("lo", "hi")  # one row


def moved_neighbors(neighbors: DataFrame, query: int, neighbor: int) -> DataFrame:
    """Neighbour table of cells that are numbered within their sets, in common numbers."""
    return neighbors.withColumns({"query": F.col("query") + query, "neighbor": F.col("neighbor") + neighbor})


def bound_rows(*parts: DataFrame) -> DataFrame:
    """Rows of matrices over the same cells, one under another."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def replaced_cells(values: DataFrame, fresh: DataFrame) -> DataFrame:
    """The matrix with the columns of all cells of ``fresh`` replaced."""
    return values.join(fresh.select("cell").distinct(), "cell", "left_anti").select("feature", "cell", "value").unionByName(fresh.select("feature", "cell", "value"))


def neighbors_of_graph(edges: DataFrame) -> DataFrame:
    """(query, neighbor, rank, dist) of a distance graph (i, j, w), nearest first; an error unless all cells have equally many neighbours."""
    spread = edges.groupBy("i").count().agg(F.min("count").alias("a"), F.max("count").alias("b")).first()
    if spread.a != spread.b:
        raise ValueError("cells have different numbers of neighbours")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("w", "j"))
    return edges.select(F.col("i").alias("query"), F.col("j").alias("neighbor"), rank.alias("rank"), F.col("w").alias("dist"))


def edge_lines(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """(line): edges of the lower triangle as 0-based numbers and the weight in 15 digits, tab separated."""
    n = lambda c: numbers.select(F.col("cell").alias(c), F.col("number").alias(f"n{c}"))
    rows = edges.join(n("i"), "i").join(n("j"), "j").filter("nj < ni")
    digits = F.regexp_replace(F.format_string("%.15g", "w"), r"(\.\d*?)0+$", "$1")
    return rows.select(F.concat_ws("\t", F.col("nj"), F.col("ni"), F.regexp_replace(digits, r"\.$", "")).alias("line"))


def write_edges(edges: DataFrame, numbers: DataFrame, path: str) -> None:
    """Write ``edge_lines`` as text files in one folder."""
    edge_lines(edges, numbers).write.mode("overwrite").text(path)


def unassigned_below(scores: DataFrame, floor: float = 0.75) -> DataFrame:
    """(cell, label, score): the label of the largest score, Unassigned where that is below the floor; ties to the first label."""
    first = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("score"), "label"))
    best = scores.withColumn("k", first).filter("k = 1")
    return best.select("cell", F.when(F.col("score") < floor, F.lit("Unassigned")).otherwise(F.col("label").cast("string")).alias("label"), "score")
