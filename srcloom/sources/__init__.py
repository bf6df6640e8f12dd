"""Sources: repository files, and parsers that turn them into facts."""
