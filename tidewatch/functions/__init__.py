"""Column functions: clamps, units, text, identity and event features."""
