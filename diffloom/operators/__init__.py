"""Comparison stages: screening of batches, triage of rows, comparison of cells, rollups and profiles."""
