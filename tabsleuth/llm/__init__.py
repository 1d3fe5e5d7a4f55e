"""Operators for training-data pipelines (chat formatting, near-duplicates,
token ids, extraction, toxicity, decontamination, byte-pair encoding, repeated
passages). Nothing else in the library imports this subpackage."""
