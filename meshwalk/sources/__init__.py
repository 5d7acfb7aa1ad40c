"""Readers, writers, deltas and generators."""
