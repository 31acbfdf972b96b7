"""marrow: knowledge-base analytics as ordinary Spark DataFrame transformations."""
