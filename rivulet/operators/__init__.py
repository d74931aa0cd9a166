"""Streams and the operators on them."""
