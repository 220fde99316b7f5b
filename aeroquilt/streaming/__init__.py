"""Incremental jobs on directories of photos."""
