"""Raster-footprint and map-tile analytics on Spark DataFrames."""
