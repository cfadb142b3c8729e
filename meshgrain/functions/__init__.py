"""functions of meshgrain."""
