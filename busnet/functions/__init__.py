"""Column expressions (geometry, tags, ordering) and array helpers."""
