"""Training-data operators: filtering, de-duplication, mixing and packing of text corpora."""
