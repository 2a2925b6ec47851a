"""Raster, region and text analytics as Spark DataFrame operators."""
