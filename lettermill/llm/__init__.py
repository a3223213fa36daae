"""Training-data operators: language-model scoring, filters, fingerprints, deduplication, packing."""
