"""Whole runs built from operators, and the registered queries with their SQL."""
