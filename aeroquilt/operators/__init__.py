"""Operators on DataFrames of frames, features, matches, raster cells and points."""
