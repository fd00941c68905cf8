"""Operators for large training-data corpora (documents, pages): packing,
mixing, sharding, near-duplicate joins, quality rules, substring and line
dedup, toxicity scoring, HTML extraction and fingerprints.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present."""
