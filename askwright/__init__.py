"""askwright: Spark-first retrieval, decision and measurement operators."""
