"""Training-data operators: sharding, quality rules, URL filters, tokenised
output, token counts, language ID, decontamination, mixing, near-duplicate and
substring deduplication.  Nothing outside this subpackage imports it."""
