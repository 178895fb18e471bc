"""Column expressions: type validators, timestamp reading, text formatting."""
