"""The streaming of the place recognition engine."""
