"""Training-data operators: scoring, extraction, joins, packing, filters and encodings for text corpora."""
