"""Tagged property values and column helpers."""
