"""Incremental and streaming forms of mergeable metrics."""
