"""Readers and writers of the canonical tables, and adaptors of generic tables to them."""
