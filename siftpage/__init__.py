"""Page analytics as Spark DataFrame operators."""
