"""Training-data operators: formatting, deduplication, selection, mixing and output of texts."""
