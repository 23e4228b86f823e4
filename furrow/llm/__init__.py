"""Training-data operators: mixing, filters, fingerprints, near-duplicates and token files."""
