"""Sparse grids as DataFrames: addressed, versioned, typed cells on Spark."""
