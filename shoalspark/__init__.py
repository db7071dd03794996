"""Before/after analysis of tracked entities, expressed as Spark DataFrame jobs."""
