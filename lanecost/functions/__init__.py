"""Column helpers: missing-value rules, text and number formatting."""
