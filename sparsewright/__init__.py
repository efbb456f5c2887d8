"""sparsewright: feature x cell matrix analytics on Spark DataFrames.

Matrices are long tables (feature, cell, value) without the zeros; everything
else is a per-cell table, a per-feature table, an embedding or an edge table.
"""

__version__ = "0.1.0"
