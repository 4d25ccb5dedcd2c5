"""Reading and writing: corpora, assignments, JSON lines, result tables."""
