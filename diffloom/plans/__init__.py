"""Whole comparisons: the lazy result, persisted runs, reports."""
