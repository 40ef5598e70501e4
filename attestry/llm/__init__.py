"""Training-data operators: language ID, licence and secret scans, PII surrogates, decontamination, deduplication, mixing, sharding."""
