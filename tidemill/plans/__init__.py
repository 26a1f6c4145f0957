"""Ordered steps over one table, with a run log."""
