"""Raster and swath archives as DataFrames."""
