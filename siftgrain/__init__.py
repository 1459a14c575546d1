"""siftgrain: a PySpark engine for culling near-duplicate media and corpora."""
