"""File layouts of common instruments and aligners, on top of the generic readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.matrix import Matrix, bundle
from sparsewright.sources import matrix_market, tables

# File names of the layouts.
PARSE_BIO = {"mtx": "DGE.mtx", "cells": "cell_metadata.csv", "features": "all_genes.csv"}
STARSOLO = {"mtx": "matrix.mtx", "cells": "barcodes.tsv", "features": "features.tsv"}


def read_parse_bio(spark: SparkSession, data_dir: str) -> Matrix:
    """Cells by rows, comma-separated names under a header."""
    p = {k: f"{data_dir}/{v}" for k, v in PARSE_BIO.items()}
    return matrix_market.read_mtx(spark, p["mtx"], p["cells"], p["features"], feature_column=2, cell_sep=",", feature_sep=",", skip_cell=1, skip_feature=1, transpose=True)


def read_starsolo(spark: SparkSession, data_dir: str) -> Matrix:
    p = {k: f"{data_dir}/{v}" for k, v in STARSOLO.items()}
    return matrix_market.read_mtx(spark, p["mtx"], p["cells"], p["features"])


def load_spatial_counts(m: Matrix, coordinates: DataFrame) -> Matrix:
    """A matrix whose cells have coordinates; cells without any go."""
    cells = m.cells.join(coordinates.select("cell", "x", "y"), "cell")
    return Matrix(m.select_cells(cells).values, cells, m.features)


def load_positional(spark: SparkSession, counts: str, genes: str, centroids: str) -> Matrix:
    """Counts as a headerless table of cells by genes, gene names and centroids by line number."""
    names = matrix_market.read_names(spark, genes, 1, ",")
    rows = matrix_market.numbered_lines(spark, counts).select("n", F.posexplode(F.split("line", ",")).alias("g", "x"))
    values = rows.join(names.select((F.col("n") - 1).cast("int").alias("g"), F.col("name").alias("feature")), "g").select("feature", F.col("n").alias("cell"), F.col("x").cast("double").alias("value"))
    places = matrix_market.numbered_lines(spark, centroids).select(F.col("n").alias("cell"), F.split("line", r"\s+").alias("p")).select("cell", F.get("p", 0).cast("double").alias("x"), F.get("p", 1).cast("double").alias("y"))
    return bundle(values, places, names.select(F.col("name").alias("feature")))


def load_transcripts(spark: SparkSession, transcripts: str, cells: DataFrame | None = None, threshold: float = 20.0, skip: str | None = None) -> Matrix:
    """A matrix counted from a transcript table, features that match ``skip`` left out."""
    values = tables.read_transcripts(spark, transcripts, threshold=threshold)
    values = values.filter(~F.col("feature").rlike(skip)) if skip else values
    return bundle(values, cells)


def flip(coordinates: DataFrame) -> DataFrame:
    """x and y exchanged."""
    return coordinates.withColumns({"x": F.col("y"), "y": F.col("x")})
