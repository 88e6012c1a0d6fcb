"""Column expressions: text, answer spans, scoring, masking."""
