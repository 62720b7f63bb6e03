"""Evidence and claim analytics as Spark DataFrame operators."""
