"""Regional attention analytics as Spark DataFrame operators."""
