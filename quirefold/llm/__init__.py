"""Training-data operators: license scans, dedup, decontamination, mixing, PII, quality, joins, scoring, media, toxicity.

Nothing else in the library imports this subpackage.
"""
