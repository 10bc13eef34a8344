"""FAQ topic-graph analytics as Spark DataFrame transformations."""
