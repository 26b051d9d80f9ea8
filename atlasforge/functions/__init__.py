"""Functions of the spatial and raster engine."""
