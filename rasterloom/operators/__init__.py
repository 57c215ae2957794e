"""Operators on rasters, regions, points, graphs and feature vectors."""
