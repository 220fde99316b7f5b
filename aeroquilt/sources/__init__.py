"""Readers and writers of survey formats."""
