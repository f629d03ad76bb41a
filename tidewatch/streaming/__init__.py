"""The streaming forms of the operators."""
