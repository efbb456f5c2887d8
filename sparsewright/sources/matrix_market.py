"""Readers and writers of matrix directories.

All of them read through Spark, so paths may be in any store that Spark
reads. Line numbers come from ``zipWithIndex``-free numbering: a monotonic id
within the file's partitions, turned into ranks by counts a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsewright.functions.scalar import unique_names
from sparsewright.matrix import Matrix


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line): a text file's lines numbered from 1, without moving lines to one task."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("id"))
    sizes = lines.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.withColumn("skip", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "skip")
    local = F.col("id").bitwiseAND((1 << 33) - 1)
    return lines.join(F.broadcast(before), "p").select((local + F.col("skip") + 1).alias("n"), "line")  # a row a partition


def read_names(spark: SparkSession, path: str, column: int = 1, sep: str = "\t", skip: int = 0, unique: bool = False, fallback: int | None = None) -> DataFrame:
    """(n, name) of a delimited file's column (from 1); empty names come from ``fallback``."""
    rows = numbered_lines(spark, path).filter(F.col("n") > skip).withColumn("n", F.col("n") - skip)
    parts = F.split("line", f"\\Q{sep}\\E")
    name = F.get(parts, column - 1)
    if fallback:
        name = F.when(F.coalesce(name, F.lit("")).isin("", "NA"), F.get(parts, fallback - 1)).otherwise(name)
    rows = rows.select("n", name.alias("name"), "line")
    return unique_names(rows, "name", "n") if unique else rows


def read_mtx(spark: SparkSession, mtx: str, cells: str, features: str, cell_column: int = 1, feature_column: int = 2, cell_sep: str = "\t", feature_sep: str = "\t", skip_cell: int = 0, skip_feature: int = 0, transpose: bool = False, unique_features: bool = True, strip_suffix: bool = False) -> Matrix:
    """A MatrixMarket coordinate file with files of cell and feature names."""
    c = read_names(spark, cells, cell_column, cell_sep, skip_cell)
    f = read_names(spark, features, feature_column, feature_sep, skip_feature, unique_features, 3 - feature_column if feature_column in (1, 2) else None)
    if strip_suffix:
        c = c.withColumn("name", F.regexp_replace("name", "-1$", ""))
    body = numbered_lines(spark, mtx).filter(~F.col("line").startswith("%") & (F.trim("line") != ""))
    head = body.orderBy("n").select("n", "line").first()
    rows, columns, _ = (int(x) for x in head.line.split())
    n_cells, n_features = c.count(), f.count()
    want = (columns, rows) if transpose else (rows, columns)
    if (n_features, n_cells) != want:
        raise ValueError(f"matrix has {want[0]} features and {want[1]} cells, the name files {n_features} and {n_cells}; is there a header to skip (skip_feature, skip_cell)?")
    p = F.split(F.trim("line"), r"\s+")
    i, j = (1, 0) if transpose else (0, 1)
    triplets = body.filter(F.col("n") != head.n).select(F.get(p, i).cast("long").alias("fi"), F.get(p, j).cast("long").alias("ci"), F.get(p, 2).cast("double").alias("value"))
    values = triplets.join(f.select(F.col("n").alias("fi"), F.col("name").alias("feature")), "fi").join(c.select(F.col("n").alias("ci"), F.col("name").alias("cell")), "ci").select("feature", "cell", "value")
    kinds = f.select(F.col("name").alias("feature"), F.get(F.split("line", f"\\Q{feature_sep}\\E"), 2).alias("kind"))
    return Matrix(values, c.select(F.col("name").alias("cell")), kinds)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_10x(spark: SparkSession, data_dir: str, gene_column: int = 2, cell_column: int = 1, unique_features: bool = True, strip_suffix: bool = False) -> dict[str, Matrix]:
    """A run's directory, in the older layout if it has genes.tsv; a matrix for each kind of feature, Gene Expression first."""
    old = _exists(spark, f"{data_dir}/genes.tsv")
    gz = "" if old else ".gz"
    names = ("barcodes.tsv", "genes.tsv" if old else "features.tsv", "matrix.mtx")
    paths = [f"{data_dir}/{x}{gz}" for x in names]
    for p in paths:
        if not _exists(spark, p):
            raise FileNotFoundError(p)
    m = read_mtx(spark, paths[2], paths[0], paths[1], cell_column, gene_column, unique_features=unique_features, strip_suffix=strip_suffix)
    kinds = [r[0] for r in m.features.select("kind").distinct().collect() if r[0]]
    if len(kinds) < 2:
        return {kinds[0] if kinds else "Gene Expression": m}
    return {k: m.select_features(m.features.filter(F.col("kind") == k)) for k in sorted(kinds, key=lambda k: (k != "Gene Expression", k))}


def read_runs(spark: SparkSession, dirs: dict[str, str], **options) -> Matrix:
    """Several runs bound by cells, ids with the run's name in front."""
    from sparsewright.operators.verbs import merge

    return merge({k: next(iter(read_10x(spark, d, **options).values())) for k, d in dirs.items()})


def write_mtx(m: Matrix, path: str) -> None:
    """Triplets with names as Parquet (``values``), and the name tables, all written in parallel."""
    m.values.write.parquet(f"{path}/values")
    m.cells.write.parquet(f"{path}/cells")
    m.features.write.parquet(f"{path}/features")


def read_written(spark: SparkSession, path: str) -> Matrix:
    return Matrix(*(spark.read.parquet(f"{path}/{x}") for x in ("values", "cells", "features")))
