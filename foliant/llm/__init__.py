"""Training-data operators: language, decontamination, sharding, secrets, toxicity, page text,
repeated passages, near copies, vector search and packing."""
