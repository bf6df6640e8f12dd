"""Parsers of source text into imports, symbols and calls."""
