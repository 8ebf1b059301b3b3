"""Training-data operators: quality, licences, mixing, near-duplicates, secrets, decontamination, sharding, token counts, WARC."""
