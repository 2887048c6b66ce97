"""Spark-first analytics for rasters, vector layers, scene catalogues and training corpora."""
