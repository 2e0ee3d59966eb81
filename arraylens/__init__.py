"""Data-quality analytics for interferometer arrays on Spark DataFrames.

Visibilities, calibration solutions, metrics and flags are long tables, one row
per sample; see ``arraylens.schema``. Operators take and return DataFrames.
"""
