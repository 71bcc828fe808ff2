"""Column expressions: text rules, geometry, coercion, time."""
