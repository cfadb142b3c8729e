"""sources of meshgrain."""
