"""The functions of the place recognition engine."""
