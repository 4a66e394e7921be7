"""Registered queries: every operator on the given tables, with plain SQL for the same result."""
