"""Training-data operators: classification, token counts, packing, personal data, decontamination, dedup, sharding."""
