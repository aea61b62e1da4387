"""Column expressions: text, vectors, ranking metrics, templates."""
