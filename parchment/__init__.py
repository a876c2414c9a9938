"""parchment: document analytics as Spark DataFrame transformations."""
