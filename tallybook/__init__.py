"""Public-budget and property analytics as Spark DataFrame programs."""
