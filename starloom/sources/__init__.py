"""Scans, table writes and the run log."""
