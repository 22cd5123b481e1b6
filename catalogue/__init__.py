"""Operators wired to the test tables, each with its SQL counterpart where one exists."""
