"""lodeframe: evidence-first analytics as Spark DataFrame plans."""
