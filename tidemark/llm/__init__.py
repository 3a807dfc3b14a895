"""Operations for large training-data pipelines: filtering, deduplication, tokenising, search and packing."""
