"""DataFrame operators: resolution, graph algorithms, quality, retrieval."""
