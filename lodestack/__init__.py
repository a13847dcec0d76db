"""lodestack: code-corpus analytics as Spark DataFrame transformations."""
