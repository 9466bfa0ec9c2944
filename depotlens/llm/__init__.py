"""Training-data operators: sharding, near-duplicates, mixing, decontamination, licences,
repeated passages, quality rules, quality model, token files and pseudonyms."""
