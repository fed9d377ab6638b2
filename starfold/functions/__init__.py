"""Part of the light-curve engine."""
