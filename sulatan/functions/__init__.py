"""Column expressions: script conversion, reply fields, box geometry."""
