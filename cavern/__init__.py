"""Persistent homology of point clouds on PySpark DataFrames."""
