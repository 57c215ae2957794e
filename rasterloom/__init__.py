"""Raster morphology, graph features and anomaly models as PySpark DataFrame operators."""
