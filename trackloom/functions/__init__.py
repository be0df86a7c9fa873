"""Column functions: text, parsing, scoring."""
