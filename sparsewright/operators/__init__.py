"""Part of sparsewright: operators."""
