"""Readers of wide tables, coordinates, scale factors and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def long_form(wide: DataFrame, cell: str, skip: str | None = None) -> DataFrame:
    """(cell, feature, value) of a table with a column for each feature, without zeros; columns that match ``skip`` are left out."""
    import re

    names = [c for c in wide.columns if c != cell and not (skip and re.search(skip, c))]
    rows = wide.select(F.col(cell).alias("cell"), *(F.col(f"`{c}`").cast("double").alias(c) for c in names))
    return rows.unpivot("cell", names, "feature", "value").filter("value != 0").select("feature", "cell", "value")


def wide_form(values: DataFrame, features: list) -> DataFrame:
    """A column for each of the given features, zeros filled: for bounded lists."""
    return values.groupBy("cell").pivot("feature", features).agg(F.sum("value")).fillna(0.0)


def read_wide(spark: SparkSession, path: str, cell: str, skip: str | None = "DAPI|Blank|Empty", **options) -> DataFrame:
    return long_form(spark.read.csv(path, header=True, **options), cell, skip)


def read_coordinates(spark: SparkSession, path: str, in_tissue: bool = True) -> DataFrame:
    """(cell, x, y) of tissue positions in CSV (with or without header) or Parquet."""
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        names = ["barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres"]
        rows = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names)).filter("barcode != 'barcode'")
    if in_tissue:
        rows = rows.filter(F.col("in_tissue").cast("int") == 1)
    return rows.select(F.col("barcode").alias("cell"), F.col("pxl_col_in_fullres").cast("double").alias("x"), F.col("pxl_row_in_fullres").cast("double").alias("y"))


def read_beads(spark: SparkSession, path: str) -> DataFrame:
    """(cell, x, y) of a CSV whose first column is the cell."""
    rows = spark.read.csv(path, header=True)
    a, b, c = rows.columns[:3]
    return rows.select(F.col(f"`{a}`").alias("cell"), F.col(f"`{b}`").cast("double").alias("x"), F.col(f"`{c}`").cast("double").alias("y"))


def read_scale_factors(spark: SparkSession, path: str) -> DataFrame:
    """(spot, fiducial, hires, lowres), one row."""
    j = spark.read.json(path, multiLine=True)
    pick = lambda c: (F.col(c) if c in j.columns else F.lit(None)).cast("double")
    return j.select(pick("spot_diameter_fullres").alias("spot"), pick("fiducial_diameter_fullres").alias("fiducial"), pick("tissue_hires_scalef").alias("hires"), pick("tissue_lowres_scalef").alias("lowres"))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(cell, vertex, x, y) of a GeoJSON feature collection of polygons."""
    schema = "features array<struct<properties:struct<cell_id:string>, geometry:struct<type:string, coordinates:array<array<array<double>>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    ring = rows.select(F.col("f.properties.cell_id").alias("cell"), F.posexplode(F.get("f.geometry.coordinates", 0)).alias("vertex", "p"))
    return ring.select("cell", "vertex", F.get("p", 0).alias("x"), F.get("p", 1).alias("y"))


def read_transcripts(spark: SparkSession, path: str, cell: str = "cell_id", feature: str = "feature_name", quality: str | None = "qv", threshold: float = 20.0) -> DataFrame:
    """(feature, cell, value): transcripts counted by cell, those under the quality threshold left out; Parquet or CSV."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    if quality and quality in rows.columns:
        rows = rows.filter(F.col(quality).cast("double") >= threshold)
    return rows.groupBy(F.col(feature).alias("feature"), F.col(cell).alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def read_nested_counts(spark: SparkSession, path: str) -> DataFrame:
    """(feature, cell, value) of a JSON object {feature: {cells: {cell: value}}}."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<cells:map<string,double>>>")).alias("feature", "v"))
    return rows.select("feature", F.explode("v.cells").alias("cell", "value")).filter("value != 0")
