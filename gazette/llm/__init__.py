"""Training-data operators: quality rules, deduplication, mixing, packing,
sharding and token counts. Nothing outside this folder imports it."""
