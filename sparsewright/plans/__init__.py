"""Part of sparsewright: plans."""
