"""Spark-first spatial and raster analytics: operators, sources, functions, plans and streaming."""
