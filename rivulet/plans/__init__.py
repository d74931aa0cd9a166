"""Parsing statements into plans."""
