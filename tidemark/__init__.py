"""Part of the tidemark engine."""
