"""Column expressions: payload extraction, limit checks and text rules."""
