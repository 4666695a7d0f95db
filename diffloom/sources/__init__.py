"""Inputs: tables by name, path or frame; synthetic pairs; the newest batches."""
