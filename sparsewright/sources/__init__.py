"""Part of sparsewright: sources."""
