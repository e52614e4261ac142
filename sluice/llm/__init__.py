"""Training-data operators: near duplicates, personal data, search, language models, stores and packing."""
