"""Readers, writers, catalogue, versioned tables, read-only SQL."""
