"""Part of sparsewright: functions."""
