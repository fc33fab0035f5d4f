"""Continuous forms of capture processing: an extension, as batches are all that the tables need."""
