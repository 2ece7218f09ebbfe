"""Training-data operators: deduplication, search, sharding, packing, language
identification, tokenisation, chat formatting and sanitisation."""
