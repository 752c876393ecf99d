"""Readers, writers and the tables derived from the test data."""
