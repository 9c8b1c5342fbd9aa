"""Operators for training-data pipelines: sharding, decontamination, PII,
language, toxicity, near duplicates, secrets, packing, chat formats and
fingerprints. Nothing outside this subpackage imports it."""
