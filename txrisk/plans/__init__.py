"""Registered queries: each reads the given tables and has a SQL twin where
SQL can express it."""
