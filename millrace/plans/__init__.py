"""From SQL text to a tree and to Spark SQL."""
