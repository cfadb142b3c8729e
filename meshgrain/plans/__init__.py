"""plans of meshgrain."""
