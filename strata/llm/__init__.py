"""Training-data operators: dedup, decontamination, scans, scoring, tokens, packing."""
