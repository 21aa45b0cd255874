"""Column functions: text, codes, similarity, scores."""
