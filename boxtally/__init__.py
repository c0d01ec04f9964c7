"""boxtally: detection analytics as Spark DataFrame operators."""
