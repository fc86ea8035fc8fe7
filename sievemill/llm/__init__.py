"""Training-data operators: sampling, near-duplicates, split overlap, answer defects, splitting, tokenising, mixing, reading level."""
