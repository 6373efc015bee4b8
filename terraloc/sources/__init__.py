"""The sources of the place recognition engine."""
