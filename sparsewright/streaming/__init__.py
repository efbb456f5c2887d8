"""Part of sparsewright: streaming."""
