"""streaming of meshgrain."""
