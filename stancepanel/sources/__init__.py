"""Readers, writers, staging and lookup tables."""
