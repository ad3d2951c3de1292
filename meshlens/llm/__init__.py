"""Training-data operators: packing, tokenising, media, de-duplication, models, formatting."""
