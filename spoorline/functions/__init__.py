"""Column expressions: text, hashing, intervals, geometry, rasters."""
