"""Training-data operators: token output, mixing, packing, classifiers, dedup, media, search."""
