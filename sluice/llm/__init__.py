"""Training-data operators: quality, language modelling, deduplication, decontamination, extraction, tokenising."""
