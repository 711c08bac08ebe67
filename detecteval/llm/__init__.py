"""Operators of a training-data pipeline: search, fingerprints, language,
source mixing, revisits, quality, toxicity, near-duplicates, URL rules and
byte-level BPE. Nothing else in the library imports this subpackage."""
