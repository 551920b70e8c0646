"""Training-data operators: language id, search, toxicity, joins, scoring, dedup, mixing, packing."""
