"""Operators wired to tables: the registered queries and the catalogue sync."""
