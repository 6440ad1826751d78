"""Training-data operators: extraction, packing, fingerprints, chat formatting,
mixing, toxicity, similarity join, repeated-passage removal and exact
deduplication. Nothing else in the library imports this subpackage."""
