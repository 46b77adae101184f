"""Document-structure and review analytics as Spark jobs."""
