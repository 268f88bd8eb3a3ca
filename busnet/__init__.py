"""Bus-network analytics on Spark: OSM elements in, map tables, documents and tiles out."""
