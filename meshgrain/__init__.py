"""meshgrain: graph, event and tabular analytics written as PySpark DataFrame programs."""
