"""The operators of the place recognition engine."""
