"""Column -> Column helpers: exact money arithmetic, parsing, formatting, dates."""
