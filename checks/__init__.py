"""Registered queries over the given tables, and SQL that states their results independently."""
