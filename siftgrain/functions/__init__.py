"""Part of siftgrain."""
