"""Registered queries, each next to the SQL that computes the same result."""
