"""Layered raster documents as Spark relations: scripts in, DataFrames out."""
