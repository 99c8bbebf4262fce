"""Column expressions: hashes, text, arithmetic."""
