"""Part of the turnwise engine."""
