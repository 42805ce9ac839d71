"""Population-genetics analytics as Spark DataFrame operators."""
