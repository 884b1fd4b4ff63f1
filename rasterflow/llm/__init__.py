"""Training-data operators: decontamination, binary token output, media, near-dedup,
toxicity, WARC, substring dedup, token counts, language ID and BPE."""
