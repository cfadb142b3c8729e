"""operators of meshgrain."""
