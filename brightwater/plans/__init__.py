"""Complete queries over the input tables."""
