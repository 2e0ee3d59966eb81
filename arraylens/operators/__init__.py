"""Operators: reductions, windows, kernels on waterfalls, flags, searches, classes and calibration metrics."""
