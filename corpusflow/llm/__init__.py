"""Training-data operators: license scan, decontamination, WARC, source mixing,
toxicity, sharding, document fingerprints, token counts, personal data and
near-duplicate detection. Each module is one operator; ``queries`` registers them."""
