"""Training-data operators: scoring, language, decontamination, mixing, PII, packing, extraction, dedup and quality."""
